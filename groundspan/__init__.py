"""Grounded information extraction over document corpora, as Spark plans."""
