"""Incremental runs over streams of files."""
