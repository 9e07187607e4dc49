"""A Spark-native engine for corpora: segmentation, tagging, retrieval, scheduling and audit."""
