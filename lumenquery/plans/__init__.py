"""lumenquery.plans"""
