"""Tessella: a PySpark-native engine that builds, checks and scores language-model text corpora."""
