"""factorspark.plans"""
