"""Surveillance analytics over document and event tables, as Spark DataFrame jobs."""
