"""All registered queries of the stop tables and logs."""

from . import cleaning, history, live, models, sealing, streams
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cleaning", "history", "live", "models", "sealing", "streams"]
