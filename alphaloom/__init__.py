"""Cross-sectional equity factor analytics on Spark DataFrames."""
