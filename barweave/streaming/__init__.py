"""Incremental form of the bar builder."""
