"""quillspan: Spark-native analytics over text corpora, property graphs and event logs."""
