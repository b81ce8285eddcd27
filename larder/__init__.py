"""Entity x measure analytics on Spark: dirty sheets to a tested star schema, and queries over it."""
