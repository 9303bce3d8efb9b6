"""All named queries and their SQL twins."""

from __future__ import annotations

from tilewright.plans import queries, streams

QUERIES = queries.QUERIES | streams.QUERIES
ORACLES = queries.ORACLES | streams.ORACLES
