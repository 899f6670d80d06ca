"""Batch stages and the registered queries."""
