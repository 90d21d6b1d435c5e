"""Data operators for PySpark: every operator takes and returns DataFrames or streams."""
