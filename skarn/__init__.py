"""skarn: a Spark-native engine for catalogs of described 3-D objects and their training data."""
