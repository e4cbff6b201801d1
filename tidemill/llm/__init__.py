"""Operators for preparing training corpora at scale.

Every operator takes and returns DataFrames and leaves partitioning to Spark.
Nothing outside this subpackage imports it.
"""
