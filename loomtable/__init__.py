"""A PySpark-native table engine: named tables, fluent queries, change capture,
text functions and hybrid retrieval, all planned by Spark."""
