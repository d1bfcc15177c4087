"""factorspark.sources"""
