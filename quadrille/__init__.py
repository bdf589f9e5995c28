"""Quadrille: an RDF knowledge-graph engine expressed as Spark DataFrames."""

__version__ = "0.1.0"
