"""loomweb: web-corpus analytics on Spark DataFrames."""
