"""Readers, writers and the logical tables made from stored ones."""
