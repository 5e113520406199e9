"""sparkloom: a PySpark-native analytics engine.

Every operator is a pure function from DataFrames and Columns to DataFrames and
Columns; Catalyst picks the physical plan.
"""
