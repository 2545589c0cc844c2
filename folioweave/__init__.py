"""Graph catalogue analytics on Spark: bibliographic records as a versioned property graph."""
