"""Batch and streaming retrieval analytics on Spark."""
