"""Readers and writers of label formats, through one canonical schema."""
