"""codefacts.sources"""
