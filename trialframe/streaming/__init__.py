"""trialframe.streaming"""
