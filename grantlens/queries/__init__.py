"""All queries by name, each with its SQL where SQL can express it."""

from . import core, delimited, filings, matching, recipients, scores, temporal
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "core", "delimited", "filings", "matching", "recipients", "scores", "temporal"]
