"""Structured Streaming counterparts of the batch folds."""
