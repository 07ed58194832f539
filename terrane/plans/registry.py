"""All queries outside the ``llm`` subpackage, and their SQL."""

from __future__ import annotations

from terrane.plans import general, reference

FLAGSHIP = "way_geometry_stats"
QUERIES: dict = {**general.QUERIES, **reference.QUERIES}
SQL: dict[str, str] = {**general.SQL, **reference.SQL}
