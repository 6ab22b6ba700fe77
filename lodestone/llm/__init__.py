"""Operators for text corpora of language models; nothing outside this package imports it."""
