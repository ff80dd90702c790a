"""Spark-native analysis of control-exchange documents, with operators for training corpora in ``tessera.llm``."""
