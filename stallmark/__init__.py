"""Catalogue analytics on Spark: listings in, one defensible ranking out."""
