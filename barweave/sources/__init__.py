"""Readers, writers and shaping of landed files."""
