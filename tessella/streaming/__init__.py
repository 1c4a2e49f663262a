"""Continuous ingest of files."""
