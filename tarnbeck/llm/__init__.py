"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and returns
DataFrames; tables that have to outlive a lost executor are written under ``spark.checkpoint.dir``.
"""
