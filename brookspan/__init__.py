"""Spark-first stream and batch analytics: DataFrame in, DataFrame out."""
