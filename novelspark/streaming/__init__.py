"""novelspark.streaming"""
