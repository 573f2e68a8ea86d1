"""Readers, writers and the mapping of the relational test tables."""
