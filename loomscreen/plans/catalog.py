"""The registered screen queries and their DuckDB oracles."""

from __future__ import annotations

from . import analogs, extras, relational, sequencing, sources, statistics

MODULES = (extras, relational, sequencing, sources, statistics)
QUERIES, ORACLES = analogs.QUERIES, analogs.ORACLES
FLAGSHIP = "p0_screen_hits"
