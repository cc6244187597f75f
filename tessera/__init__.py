"""Tessera: a PySpark-native engine for retrieval, knowledge-graph and corpus work."""
