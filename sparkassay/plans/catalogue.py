"""All queries of the engine by name, and the SQL that each is held against."""

from __future__ import annotations

from sparkassay.plans import analytics, basics, extras, procedures, remainder, singles  # noqa: F401  they register their queries
from sparkassay.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
