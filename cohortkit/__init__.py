"""Cohort analytics as PySpark DataFrame operators.

``sources`` reads tables, ``functions`` cleans columns, ``operators`` turns one
DataFrame into another, ``plans`` combines them into whole analyses.
"""
