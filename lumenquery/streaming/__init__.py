"""lumenquery.streaming"""
