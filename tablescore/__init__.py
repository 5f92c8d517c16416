"""Table-extraction scoring on Spark DataFrames."""

from .shipping import ship

__all__ = ["ship"]
