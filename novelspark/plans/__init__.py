"""novelspark.plans"""
