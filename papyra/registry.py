"""Queries and oracles of all operators outside the training-data subpackage."""

from __future__ import annotations

from papyra.operators import embedding, extraction, ingestion, lineage, mapping, reading, retrieval, telemetry, validation

MODULES = (reading, mapping, validation, extraction, lineage, embedding, retrieval, ingestion, telemetry)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
