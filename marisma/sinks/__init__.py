"""Sinks: table states after inserts, updates and deletes."""
