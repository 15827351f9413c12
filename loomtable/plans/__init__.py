"""The library's queries over the test tables; importing a module registers its queries."""

from . import histories, relational, states, tables, texts
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "histories", "relational", "states", "tables", "texts"]
