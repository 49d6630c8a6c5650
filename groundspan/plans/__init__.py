"""Specifications and the plans compiled from them."""
