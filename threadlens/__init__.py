"""Discussion analytics on Spark: posts, the comments under them, and external daily series."""
