"""lumenquery.functions"""
