"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts with few neighbours apart: halves along the main
direction, then moves of single nodes to the part that holds most of their neighbours, as long as the parts stay within
``SLACK`` of the mean. Two small classifiers (softmax regression) carry the parts over to all rows: one places a row into
its part, one routes a query to the parts that probably hold its neighbours. A query takes the most probable parts
until they carry a given share of the probability; the share is the one that reaches ``recall`` for sample rows that
neither the graph nor the classifiers have seen. Every row is placed, and all rows of the chosen parts are compared.

The rows of a part are packed into blocks of bounded size, as are the queries that visit it, and a task gets one block of
rows with one block of queries, so that a part that holds most of the rows is searched by many tasks. A pair of blocks
sends the best ``k`` of each query. Scores are sums in the order of the components, so that equal vectors tie.

Bounds: the sample (``sample`` rows, by a hash of id and vector; it alone comes to the driver, with two weight tables of
dimensions times parts) and the blocks. A sample of the whole table, or one part, gives an exact search.

Defined cases: vectors that are NULL, empty or zero, or hold NULL or a component that is not finite take no part, nor do
vectors of another length than the most frequent one (of equally frequent lengths the longest counts). A NULL id is a
candidate only, after other ids among ties. Rows that repeat an id are candidates one by one, and a query is not compared
with rows of its own id; of several vectors of a query's id the smallest asks. Equal vectors tie, and smaller ids come
first. Texts are not read, so their length does not matter; other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import ship
from threadlens.sources.sinks import store

#: Share by which a part may be larger or smaller than the mean.
SLACK = 0.1
#: Neighbours of a node of the graph.
DEGREE = 10
#: Rows of a block.
BLOCK = 2048
#: Most parts: as many as a sample of the default size can teach.
PARTS = 128


def usable_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``vector`` of the rows that take part."""
    vector = F.col(vector_col)
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    if kind != "float":
        vector = vector.cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vector.alias("vector"))
    finite = F.forall("vector", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("vector") == (length["length"] if length else 0))


def nearest_rows(queries: np.ndarray, rows: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """Places of the ``k`` rows with the largest inner product; with ``own`` query i is row i and left out."""
    found = []
    for at in range(0, len(queries), 512):
        scores = queries[at : at + 512] @ rows.T
        if own:
            scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        found.append(np.argpartition(-scores, k - 1, axis=1)[:, :k])
    return np.concatenate(found)


def halved(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Equal parts (a power of two): each half is cut again at the median of its main direction."""
    labels, known = np.zeros(len(vectors), int), 1
    while known < parts:
        cut = np.empty_like(labels)
        for part in range(known):
            members = np.flatnonzero(labels == part)
            centred = vectors[members] - vectors[members].mean(axis=0) if len(members) else vectors[members]
            main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = members[np.argsort(centred @ main, kind="stable")]
            cut[order[: len(order) // 2]], cut[order[len(order) // 2 :]] = 2 * part, 2 * part + 1
        labels, known = cut, 2 * known
    return labels


def balanced_parts(vectors: np.ndarray, links: np.ndarray, parts: int, sweeps: int = 15) -> np.ndarray:
    """Labels of the nodes of a graph (``links``: the neighbours of each): few links between parts, sizes in bounds."""
    n, degree = links.shape
    labels = halved(vectors, parts)
    ends = np.concatenate([np.repeat(np.arange(n), degree), links.ravel()])
    others = np.concatenate([links.ravel(), np.repeat(np.arange(n), degree)])[np.argsort(ends, kind="stable")]
    starts = np.searchsorted(np.sort(ends), np.arange(n + 1))
    held = np.zeros((n, parts))
    np.add.at(held, (np.sort(ends), labels[others]), 1)
    sizes = np.bincount(labels, minlength=parts)
    least, most = n / parts * (1 - SLACK), n / parts * (1 + SLACK)
    for _ in range(sweeps):
        gains = held.max(axis=1) - held[np.arange(n), labels]
        moved = 0
        for node in np.argsort(-gains, kind="stable").tolist():
            here = labels[node]
            if sizes[here] <= least:
                continue
            there = int(np.where(sizes < most, held[node], -1).argmax())
            if held[node, there] > held[node, here]:
                labels[node] = there
                sizes[here], sizes[there], moved = sizes[here] - 1, sizes[there] + 1, moved + 1
                around = others[starts[node] : starts[node + 1]]
                np.add.at(held, (around, here), -1)
                np.add.at(held, (around, there), 1)
        if moved < n / 500:
            break
    return labels


def _with_one(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.concatenate([vectors / scale, np.ones((len(vectors), 1))], axis=1)


def _softmax(scores: np.ndarray) -> np.ndarray:
    grown = np.exp(scores - scores.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


def fit_softmax(features: np.ndarray, targets: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of a softmax regression on target distributions (gradient steps with running moments)."""
    weights = np.zeros((features.shape[1], targets.shape[1]))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        slope = features.T @ (_softmax(features @ weights) - targets) / len(features) + decay * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


@dataclass
class Router:
    """Places rows into parts and routes queries to them."""

    place: np.ndarray
    route: np.ndarray
    scale: float
    share: float

    def parts(self) -> int:
        return self.place.shape[1]

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        return (_with_one(vectors, self.scale) @ self.place).argmax(axis=1)

    def before(self, vectors: np.ndarray) -> np.ndarray:
        """For every query and part the probability of the parts that are visited earlier."""
        chances = _softmax(_with_one(vectors, self.scale) @ self.route)
        order = np.argsort(-chances, axis=1, kind="stable")
        ordered = np.take_along_axis(chances, order, 1)
        earlier = np.empty_like(chances)
        np.put_along_axis(earlier, order, np.concatenate([np.zeros((len(chances), 1)), np.cumsum(ordered, axis=1)[:, :-1]], axis=1), 1)
        return earlier

    def visited(self, vectors: np.ndarray) -> np.ndarray:
        """Whether a query visits a part, for every query and part."""
        return self.before(vectors) <= self.share


def parts_for(n: int, most: int = PARTS) -> int:
    """A power of two near an eighth of the root of the number of rows."""
    return int(min(most, 2 ** max(0, round(np.log2(max(1.0, np.sqrt(n) / 8))))))


def fit_router(sample: np.ndarray, parts: int, k: int = 20, recall: float = 0.95) -> Router | None:
    """Graph, parts, classifiers and share from the sample; None if it is too small for several parts."""
    vectors = np.unique(sample, axis=0).astype(np.float64)
    vectors = vectors[np.random.default_rng(1).permutation(len(vectors))]
    asked = len(vectors) // 8
    seen, unseen = vectors[asked:], vectors[:asked]
    if parts < 2 or len(seen) <= max(2 * parts, 2 * k, DEGREE + 1):
        return None
    labels = balanced_parts(seen, near := nearest_rows(seen, seen, DEGREE, own=True), parts)
    scale = float(np.sqrt((seen**2).mean()))
    features, each = _with_one(seen, scale), np.arange(len(seen))
    wanted = np.zeros((len(seen), parts))
    np.add.at(wanted, (np.repeat(each, DEGREE), labels[near].ravel()), 0.5 / DEGREE)
    wanted[each, labels] += 0.5
    router = Router(fit_softmax(features, wanted), np.zeros((0, 0)), scale, 1.0)
    placed = router.placed(seen)
    spread = np.zeros((len(seen), parts))
    np.add.at(spread, (np.repeat(each, k), placed[nearest_rows(seen, seen, k, own=True)].ravel()), 1 / k)
    router.route = fit_softmax(features, spread)
    needed = np.take_along_axis(router.before(unseen), placed[nearest_rows(unseen, seen, k)], 1)
    router.share = float(np.quantile(needed, recall))
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _blocks(rows: DataFrame, per_block: int) -> DataFrame:
    """How many blocks of about ``per_block`` rows each part has; at most ``PARTS`` rows."""
    return rows.groupBy("part").agg(F.ceil(F.count("*") / per_block).cast("int").alias("blocks"))


def _packed(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``part``, ``block``, ``ids`` and ``vectors`` (all components of a block): the rows of every part in its blocks."""
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(sizes), "part")
    block = F.pmod(F.xxhash64("__row"), F.col("blocks")).cast("int")
    packed = dealt.select("part", block.alias("block"), F.struct("id", "vector").alias("row")).groupBy("part", "block").agg(F.collect_list("row").alias("rows"))
    return packed.select("part", "block", F.col("rows.id").alias("ids"), F.flatten("rows.vector").alias("vectors"))


def best_in_block(queries: np.ndarray, rows: np.ndarray, same: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query places, row places and scores of each query's best ``k`` rows (ties by ``order``), without ``same`` pairs."""
    scores = queries @ rows.T
    scores[same] = -np.inf
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    # The fast product may differ in the last digits from the ordered sum.
    margin = 1e-12 * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max()
    asks, at = np.nonzero((scores >= (kth - margin)[:, None]) & (scores > -np.inf))
    exact = np.zeros(len(asks))
    for component in range(queries.shape[1]):
        exact += queries[asks, component] * rows[at, component]
    ranked = np.lexsort((order[at], -exact, asks))
    asks, at, exact = asks[ranked], at[ranked], exact[ranked]
    place = np.arange(len(asks)) - np.searchsorted(asks, asks)
    return asks[place < k], at[place < k], exact[place < k]


def nearest_neighbours(
    df: DataFrame, is_query: str, k: int = 20, sample: int = 8192, recall: float = 0.95, parts: int | None = None, block: int = BLOCK,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``score``: the rows of largest inner product found for the rows that ``is_query`` marks.

    ``is_query`` is a SQL condition on the column ``id``. ``parts`` fixes the number of parts (a power of two).
    """
    ship(df.sparkSession)
    rows = usable_vectors(df, id_col, vector_col)
    n = rows.count()
    drawn = F.xxhash64("id", "vector")
    lot = rows.where(F.pmod(drawn, F.lit(1 << 32)) < int(min(1.0, 1.2 * sample / max(n, 1)) * (1 << 32)))
    picked = lot.orderBy(drawn, "id", "vector").limit(sample).select("vector").toArrow().column(0)
    router = fit_router(_matrix(pa.concat_arrays(picked.chunks)), parts or parts_for(n), k, recall) if len(picked) else None
    kind = rows.schema["id"].dataType.simpleString()
    vector_kind = rows.schema["vector"].dataType.simpleString()

    def spread(visits: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if router is None:
                    at, part = np.arange(batch.num_rows), np.zeros(batch.num_rows, int)
                else:
                    vectors = _matrix(batch.column(1)).astype(np.float64)
                    at, part = np.nonzero(router.visited(vectors)) if visits else (np.arange(len(vectors)), router.placed(vectors))
                chosen = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), chosen.column(0), chosen.column(1)], ["part", "id", "vector"])

        return run

    schema = f"part int, id {kind}, vector {vector_kind}"
    asking = rows.where(F.expr(is_query) & F.col("id").isNotNull()).groupBy("id").agg(F.min("vector").alias("vector"))
    placed = store(rows.mapInArrow(spread(False), schema), "placed")
    routed = store(asking.mapInArrow(spread(True), schema), "routed")
    sizes = _blocks(placed, block)
    blocks = _packed(placed, sizes).withColumnsRenamed({"ids": "row_ids", "vectors": "rows"})
    # Each block of queries is sent to each block of rows of its part, so a large part has as many keys as blocks.
    asks = _packed(routed, _blocks(routed, block)).join(F.broadcast(sizes), "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    met = blocks.join(asks, ["part", "block"]).select("row_ids", "rows", "query_ids", "queries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row_ids, query_ids = batch.column(0)[at].values, batch.column(2)[at].values
                found = batch.column(1)[at].values.to_numpy(zero_copy_only=False).reshape(len(row_ids), -1).astype(np.float64)
                asked = batch.column(3)[at].values.to_numpy(zero_copy_only=False).reshape(len(query_ids), -1).astype(np.float64)
                codes = pa.chunked_array([row_ids, query_ids]).combine_chunks().dictionary_encode().indices.to_pandas().fillna(-1).to_numpy()
                same = codes[len(row_ids) :][:, None] == codes[: len(row_ids)][None, :]
                order = np.empty(len(row_ids), int)
                order[pa.compute.sort_indices(row_ids, null_placement="at_end").to_numpy()] = np.arange(len(row_ids))
                who, which, scores = best_in_block(asked, found, same, order, k)
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(who)), row_ids.take(pa.array(which)), pa.array(scores)], ["query_id", "id", "score"])

    found = met.mapInArrow(search, f"query_id {kind}, id {kind}, score double")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
