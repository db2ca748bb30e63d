"""quorant: a Spark-native engine for vote, filter, grade and training-data analytics."""
