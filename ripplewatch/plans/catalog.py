"""The registry of runnable queries, each with the SQL that checks it where SQL can express it."""

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ripplewatch import inventory as inv
from ripplewatch.plans.tables import Tables, flows_sql


@dataclass(frozen=True)
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}

_RESOLVE = """
  SELECT i.identifier,
    CASE WHEN x.name IS NOT NULL THEN x.name WHEN i.host IS NOT NULL AND n.name IS NOT NULL THEN n.name
         ELSE concat('Unresolved_', regexp_replace(i.identifier, '[^A-Za-z0-9_]', '_', 'g')) END AS asset,
    CASE WHEN x.name IS NOT NULL THEN x.criticality WHEN n.name IS NOT NULL THEN n.criticality
         ELSE CAST(0.1 AS DOUBLE) END AS criticality,
    CASE WHEN x.name IS NOT NULL THEN CAST(1.0 AS DOUBLE)
         WHEN n.name IS NOT NULL THEN greatest(CAST(0.4 AS DOUBLE), 1.0::DOUBLE - n.d * 0.12::DOUBLE)
         ELSE CAST(0.3 AS DOUBLE) END AS confidence,
    x.name IS NOT NULL AS is_known
  FROM (SELECT identifier, TRY_CAST(NULLIF(regexp_extract(identifier, '^10\\.0\\.1\\.(\\d+)$', 1), '') AS INT) AS host
        FROM (SELECT source_ip AS identifier FROM flows UNION SELECT destination_ip FROM flows)) i
  LEFT JOIN registry x ON x.identifier = i.identifier
  LEFT JOIN (SELECT host, name, criticality, d,
                    row_number() OVER (PARTITION BY host ORDER BY d, position) AS rn
             FROM (SELECT h.host, r.name, r.criticality, r.position, abs(h.host - r.host) AS d
                   FROM (SELECT DISTINCT TRY_CAST(NULLIF(regexp_extract(identifier, '^10\\.0\\.1\\.(\\d+)$', 1), '') AS INT) AS host
                         FROM (SELECT source_ip AS identifier FROM flows UNION SELECT destination_ip FROM flows)) h
                   JOIN (SELECT *, TRY_CAST(NULLIF(regexp_extract(identifier, '^10\\.0\\.1\\.(\\d+)$', 1), '') AS INT) AS host
                         FROM registry) r
                     ON abs(h.host - r.host) <= 5)) n
    ON n.host = i.host AND n.rn = 1
"""

_CTES: dict[str, str] = {
    "flows": flows_sql(),
    "assets": inv.values_sql(inv.ASSETS, inv.ASSET_COLUMNS),
    "registry": inv.values_sql(inv.registry_rows(), inv.REGISTRY_COLUMNS),
    "decoys": inv.values_sql(inv.DECOYS, ("gateway_zone", "credential_id", "username", "emulated_protocol")),
    "resolution": _RESOLVE,
    "resolved": """
  SELECT f.*, s.asset AS source_asset, s.criticality AS source_criticality,
    d.asset AS destination_asset, d.criticality AS destination_criticality,
    (s.confidence + d.confidence) / 2 AS resolution_confidence
  FROM flows f JOIN resolution s ON s.identifier = f.source_ip JOIN resolution d ON d.identifier = f.destination_ip
""",
}


def cte(name: str, sql: str) -> None:
    """Add a named subquery that checking SQL may use."""
    _CTES[name] = sql


def _needed(sql: str, found: set[str]) -> None:
    for name, body in _CTES.items():
        if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            found.add(name)
            _needed(body, found)


def expand(sql: str) -> str:
    """Prepend the named subqueries that ``sql`` mentions."""
    found: set[str] = set()
    _needed(sql, found)
    body = sql.strip()
    if not found:
        return body
    heads = ", ".join(f"{name} AS ({_CTES[name]})" for name in _CTES if name in found)
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if own:
        return f"WITH RECURSIVE {heads}, {body[own.end():]}"
    return f"WITH RECURSIVE {heads} {body}"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name!r} is registered twice")
        CATALOG[name] = Query(fn, expand(sql) if sql else None)
        return fn

    return register


def load() -> dict[str, Query]:
    """Import every query module and return the catalog."""
    from importlib import import_module

    for module in (
        "preparation",
        "resolution",
        "channels",
        "ordered",
        "rollups",
        "evaluation",
        "graphs",
        "policy",
        "serving",
        "storage",
        "live",
    ):
        import_module(f"ripplewatch.plans.{module}")
    return CATALOG
