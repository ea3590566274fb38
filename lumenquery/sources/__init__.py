"""lumenquery.sources"""
