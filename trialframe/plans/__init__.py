"""trialframe.plans"""
