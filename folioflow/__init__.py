"""Analytics over PDF document corpora, expressed as Spark DataFrame operations."""
