"""lumenquery: a Spark-native analytics engine for media catalogues and text corpora."""
