"""Analytics over collections of repeated exposures, as Spark DataFrame operations."""
