"""A Spark-native code-intelligence analytics engine."""
