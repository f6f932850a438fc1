"""lumenframe: a PySpark-native analytics engine for media catalogues.

Every operator is a function from DataFrames to a DataFrame; Catalyst and
Tungsten choose the physical plan.
"""
