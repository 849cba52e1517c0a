"""Lineage extraction and lineage-graph analysis over corpora of scripts and job files, as Spark jobs."""
