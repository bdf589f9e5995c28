"""SPARQL: parser, algebra, compiler to DataFrames, updates."""
