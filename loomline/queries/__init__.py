"""Registered queries over the given tables, each with the SQL that checks it."""

from loomline.queries.registry import QUERIES, ORACLE

# Importing the modules registers their queries.
from loomline.queries import (  # noqa: E402,F401
    blocking, comparing, evaluating, lines, matching, mining, streams)

__all__ = ["QUERIES", "ORACLE"]
