"""Connected components of an edge table: those of the library."""

from strandwise.operators.graph import components

__all__ = ["components"]
