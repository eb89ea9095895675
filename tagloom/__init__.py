"""A Spark-native engine that treats XML as tables of events."""
