"""Tessera: a Spark-native engine for catalogue analytics over plain DataFrames."""
