"""lociq: a Spark-native engine for marker-completeness analytics."""
