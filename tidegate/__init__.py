"""tidegate: a feature store and data-reliability gate written as Spark jobs."""
