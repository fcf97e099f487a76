"""Whole runs: the table folders, ingest and merge."""
