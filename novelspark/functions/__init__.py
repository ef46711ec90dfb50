"""novelspark.functions"""
