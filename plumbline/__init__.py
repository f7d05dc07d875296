"""plumbline: Spark-native operators for trustworthy evaluation data."""
