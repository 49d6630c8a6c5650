"""Operators: DataFrame to DataFrame, over relations keyed by document and field."""
