"""A Spark-first retrieval and analytics engine."""
