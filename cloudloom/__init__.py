"""A Spark-native engine for point clouds of buildings and plants."""
