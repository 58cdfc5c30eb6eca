"""Readers and writers: CSV ingest, stored tables, row samples and counts."""
