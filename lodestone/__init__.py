"""Spark-native hybrid retrieval over one table of text chunks, with the data-quality operators a large corpus needs."""
