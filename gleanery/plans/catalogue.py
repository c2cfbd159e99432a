"""All named queries over the engine's operators, each with the SQL that must give the same rows where SQL can."""

from . import boxes, details, library, pixels, searches, similarity, values
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "boxes", "details", "library", "pixels", "searches", "similarity", "values"]
