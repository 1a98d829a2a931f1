"""A Spark-native engine that searches and maintains a catalog of files and folders."""
