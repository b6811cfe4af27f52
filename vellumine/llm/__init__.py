"""Operators for preparing text corpora for language models; nothing outside imports this package."""
