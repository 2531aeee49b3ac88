"""Spark jobs over catalog change logs, snapshots, lineage graphs and deployment history."""
