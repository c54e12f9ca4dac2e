"""A Spark-native record-linkage and analytics engine."""
