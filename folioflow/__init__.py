"""Corpus analytics on Spark: boilerplate removal, search, paging, comparison and conversion ledgers."""

__version__ = "0.1.0"
