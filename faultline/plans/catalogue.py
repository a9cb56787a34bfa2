"""All queries of the core: name -> (spark, folder of tables) -> DataFrame, and their SQL."""

from __future__ import annotations

from faultline.plans import code, keys, models, records, reports, retrieval, routing, scores

MODULES = (code, keys, scores, routing, reports, records, retrieval, models)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
