"""Registries, typed parameters and declarative pipelines of operators."""
