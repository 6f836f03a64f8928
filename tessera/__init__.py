"""Tessera: a PySpark-native engine for evidence-checked catalogues and text corpora."""
