"""trialframe.sources"""
