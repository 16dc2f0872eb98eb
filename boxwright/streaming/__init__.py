"""Incremental evaluation over arriving label files."""
