"""lumenquery.operators"""
