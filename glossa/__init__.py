"""A Spark-native text-analytics engine."""
