"""Registration of queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadlens.catalog.views import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _with_views(sql: str, names: tuple[str, ...]) -> str:
    needed: list[str] = []

    def add(name: str) -> None:
        requires, _ = SQL_VIEWS[name]
        for other in requires:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in needed) + "\n" + sql


def query(key: str, sql: str | None = None, views: tuple[str, ...] | str = ()):
    """Register the decorated function; ``sql`` may use the named SQL views."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = _with_views(sql, (views,) if isinstance(views, str) else tuple(views))
        return fn

    return register


def normal_equations(source: str, target: str, features: list[str], by: str = "") -> str:
    """SQL of (``by``, n, intercept, mse, r2, b0, b1, ...): the normal equations by elimination and back substitution."""
    names, p = [f"CAST({c} AS DOUBLE)" for c in [*features, target]], len(features)
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    key = f"{by}, " if by else ""
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*features, target])
    sql = (f"(SELECT {key}count(*) AS n, " + ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(names)) + ", "
           + ", ".join(f"covar_pop({names[i]}, {names[j]}) AS s{i}_{j}" for i, j in pairs)
           + f", var_pop({names[p]}) AS spread FROM {source} WHERE {known}" + (f" GROUP BY {by}" if by else "") + ")")
    for k in range(p):
        rest = ", ".join(f"s{i}_{j} - s{k}_{i} * s{k}_{j} / s{k}_{k} AS s{i}_{j}" for i, j in pairs if i > k)
        sql = f"(SELECT * REPLACE ({rest}) FROM {sql})"
    for k in reversed(range(p)):
        known_part = "".join(f" - s{k}_{j} * b{j}" for j in range(k + 1, p))
        sql = f"(SELECT *, (s{k}_{p}{known_part}) / s{k}_{k} AS b{k} FROM {sql})"
    intercept = f"m{p}" + "".join(f" - b{k} * m{k}" for k in range(p))
    return (f"(SELECT {key}n, {intercept} AS intercept, s{p}_{p} AS mse, 1 - s{p}_{p} / spread AS r2, "
            + ", ".join(f"b{k}" for k in range(p)) + f" FROM {sql})")
