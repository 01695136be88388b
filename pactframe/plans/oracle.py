"""Fragments of DuckDB SQL shared by the comparison queries."""

from __future__ import annotations

from ..operators.timeline import seconds

LABEL = "'%Y-%m-%dT%H:%M:%SZ'"


def bucket(column: str, size: str) -> str:
    us = seconds(size) * 1_000_000
    return f"strftime(make_timestamp((epoch_us({column}) // {us}) * {us}), {LABEL})"


def now(view: str, column: str) -> str:
    return f"clock AS (SELECT max({column}) AS now FROM {view})"


def since(window: str) -> str:
    return f"date_trunc('second', now - INTERVAL {seconds(window)} SECOND)"


def axis(window: str, size: str) -> str:
    s, w = seconds(size), seconds(window)
    end = "CAST(floor(epoch_us(now) / 1000000) AS BIGINT)"
    return (
        f"axis AS (SELECT strftime(make_timestamp(e * 1000000), {LABEL}) AS bucket FROM "
        f"(SELECT unnest(range((({end} - {w}) // {s}) * {s}, ({end} // {s}) * {s} + 1, {s})) AS e FROM clock))"
    )


def percentiles(name: str, source: str, value: str, key: str | None = None) -> str:
    part = f"PARTITION BY {key}" if key else ""
    cols = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return (
        f"{name} AS (SELECT {cols}max(CASE WHEN rn = (n * 50 + 99) // 100 THEN v END) AS p50, "
        f"max(CASE WHEN rn = (n * 95 + 99) // 100 THEN v END) AS p95 FROM (SELECT {cols}{value} AS v, "
        f"row_number() OVER ({part} ORDER BY {value}) AS rn, count(*) OVER ({part}) AS n FROM {source} "
        f"WHERE {value} IS NOT NULL AND status IN ('done', 'failed', 'interrupted', 'cancelled')) {group})"
    )
