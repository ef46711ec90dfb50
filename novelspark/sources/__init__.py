"""novelspark.sources"""
