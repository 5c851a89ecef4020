"""Whole runs: ingest, answer and health."""
