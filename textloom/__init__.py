"""Spark-native document and text analytics: DataFrame-to-DataFrame operators, sources, functions and plans."""
