"""codefacts.operators"""
