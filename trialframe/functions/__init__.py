"""trialframe.functions"""
