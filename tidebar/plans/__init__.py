"""Whole runs: configuration, planning of missing work, and table layout."""
