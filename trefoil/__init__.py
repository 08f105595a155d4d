"""Trefoil: enrichment scores, graphlet orbits and t-SNE maps as Spark DataFrame jobs."""

__version__ = "0.1.0"
