"""Registry of runnable queries and their SQL counterparts over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, tuple[str, dict[str, int]]] = {}
FRAGMENTS: dict[str, str] = {}


def fragment(name: str, sql: str) -> None:
    """Name a shared table expression; it may use other fragments."""
    FRAGMENTS[name] = sql.strip()


def _needed(sql: str, found: list[str]) -> list[str]:
    """Fragments `sql` uses, directly or not, each after those it uses itself."""
    words = set(re.findall(r"[a-z_0-9]+", sql.lower()))
    for name, text in FRAGMENTS.items():
        if name in words and name not in found and text != sql:
            _needed(text, found)
            found.append(name)
    return found


def complete_sql(sql: str) -> str:
    """Prefix the fragments. `sql` is a select, or `name as (...), ... select ...`."""
    sql = sql.strip()
    parts = [f"{name} as materialized ({FRAGMENTS[name]})" for name in _needed(sql, [])]
    if not parts:
        return sql if sql.lower().startswith("select") else "with " + sql
    glue = "\n" if sql.lower().startswith("select") else ",\n"
    return "with " + ",\n".join(parts) + glue + sql


def _digits(spec: str) -> dict[str, int]:
    """"mean share:4" means mean to 6 digits and share to 4."""
    pairs = [item.split(":") for item in spec.split()]
    return {p[0]: int(p[1]) if len(p) > 1 else 6 for p in pairs}


def query(name: str, sql: str | None = None, rnd: str = ""):
    """Register a query; `sql` is the same question asked in plain SQL.

    Sums of doubles depend on their order in the last bits, so the columns in `rnd` are rounded on
    both sides; adding 0.0 turns a negative zero into zero.
    """
    digits = _digits(rnd)

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = fn(spark, folder)
            rounded = {c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()}
            return out.withColumns(rounded) if rounded else out

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql, digits
        return run
    return keep


def oracles() -> dict[str, str]:
    """Complete SQL of every query that has one."""
    out = {}
    for name, (sql, digits) in SQL.items():
        text = complete_sql(sql)
        if digits:
            rounded = ", ".join(f'round("{c}", {d}) + 0.0::double as "{c}"' for c, d in digits.items())
            text = f"select * replace ({rounded}) from ({text}) as answer"
        out[name] = text
    return out
