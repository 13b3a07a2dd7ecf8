"""codefacts.plans"""
