"""All registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import ingest, report, retrieve, state, texts

GROUPS = (ingest, texts, retrieve, state, report)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for g in GROUPS for k, f in g.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for g in GROUPS for k, s in g.ORACLES.items()}
