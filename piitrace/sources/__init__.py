"""Readers, writers, fixed dimensions and derived incident tables."""
