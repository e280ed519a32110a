"""Word tables looked up inside a row, without a shuffle."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A table of at most this many rows may travel inside the plan (about 1 MB); more go through a join.
INLINE_LIMIT = 20_000
_SLOTS = 512


def unique_keys(table: DataFrame, key: str, value: str) -> DataFrame:
    """``table`` with one row per key; among several values of a key the largest stays."""
    return (table.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
            .groupBy(key).agg(F.max(value).alias(value)))


def inline_lookup(
    table: DataFrame, key: str, value: str, limit: int = INLINE_LIMIT
) -> Callable[[Column], Column] | None:
    """A function from a key column to its value column (NULL if absent), or None if ``table`` is too big.

    At most ``limit + 1`` rows are fetched to find out. Spark searches a map from front to back, so the
    rows are spread over about as many small maps by the hash of their key and each search sees an entry or two.
    """
    kind = dict(table.dtypes)[value]
    rows = (unique_keys(table, key, value)
            .select(F.col(key).cast("string"), F.col(value), F.hash(F.col(key).cast("string")))
            .limit(limit + 1).collect())
    if len(rows) > limit:
        return None
    n_slots = max(_SLOTS, len(rows))
    slots: list[dict] = [{} for _ in range(n_slots)]
    for word, result, code in rows:
        slots[code % n_slots][word] = result
    maps = F.from_json(F.lit(json.dumps(slots)), f"array<map<string,{kind}>>")
    return lambda word: F.get(maps, F.pmod(F.hash(word), F.lit(n_slots)))[word]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression that is merely named in a lambda is computed again for every element the lambda sees,
    which makes work on an array quadratic. As the single element of an array it becomes a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_strings(values: list[str]) -> Column:
    """A constant array of strings, built from one literal whatever its length."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")
