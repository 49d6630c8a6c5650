"""Extraction over streams of documents."""
