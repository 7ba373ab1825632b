"""A Spark-native engine for searching, cleaning, comparing and transforming document collections."""
