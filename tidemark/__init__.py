"""tidemark: a Spark-first engine for change-feed lakehouses."""
