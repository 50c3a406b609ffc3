"""Readers, connectors and test-table adapters."""
