"""codefacts.streaming"""
