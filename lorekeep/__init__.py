"""A Spark-native engine for searching and governing Markdown knowledge."""
