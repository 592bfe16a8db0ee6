"""aforo: Spark-native analytics for metered consumption and large text corpora."""
