"""trialframe.operators"""
