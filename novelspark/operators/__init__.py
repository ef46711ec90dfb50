"""novelspark.operators"""
