"""factorspark.streaming"""
