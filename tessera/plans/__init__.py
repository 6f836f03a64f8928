"""Named queries over the driver tables and their SQL statements."""

from . import activity, catalogue, imports, matching, rules, search, services, texts, tracker
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "activity", "catalogue", "imports", "matching", "rules", "search", "services", "texts", "tracker"]
