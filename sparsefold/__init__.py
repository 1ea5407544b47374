"""Spark-native engine for sparse integer counts, with training-data operators in ``sparsefold.llm``."""
