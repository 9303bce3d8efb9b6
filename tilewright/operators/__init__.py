"""Relational forms of the image operators; each takes and returns DataFrames."""
