"""Readers: declared models from dataclasses, schemas and tables."""
