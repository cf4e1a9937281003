"""Readers, writers and literal tables."""
