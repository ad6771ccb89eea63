"""All registered queries and their DuckDB texts."""

from __future__ import annotations

from tangency.plans import context_catalogue, group_catalogue, pairs_catalogue, queue_catalogue, runtime_catalogue

QUERIES = pairs_catalogue.QUERIES | group_catalogue.QUERIES | runtime_catalogue.QUERIES | queue_catalogue.QUERIES | context_catalogue.QUERIES
ORACLES = pairs_catalogue.ORACLES | group_catalogue.ORACLES | runtime_catalogue.ORACLES | queue_catalogue.ORACLES | context_catalogue.ORACLES
