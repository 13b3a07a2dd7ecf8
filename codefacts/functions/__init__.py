"""codefacts.functions"""
