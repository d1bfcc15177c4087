"""factorspark.functions"""
