"""tessera: Spark-native analytics over source-like text corpora and finding tables."""
