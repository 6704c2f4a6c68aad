"""Operators for preparing large text corpora: packing, search, encoding, filtering and scoring."""
