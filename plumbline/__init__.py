"""Certified context retrieval on Spark: fused top-k search with provable bounds, over DataFrames and Parquet."""
