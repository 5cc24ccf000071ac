"""Readers, writers and the adapters for the shipped test tables."""
