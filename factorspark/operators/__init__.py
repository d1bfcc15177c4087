"""factorspark.operators"""
