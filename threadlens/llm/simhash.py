"""Near-duplicates by SimHash fingerprints.

A fingerprint has a bit set where over half of the hashes of the word shingles have it. Fingerprints that differ in at
most ``distance`` bits are linked: the 64 bits are cut into more blocks than that, so a close pair agrees in some of
them whatever bits differ; fingerprints are joined on every choice of agreeing blocks, and the distance is verified.

Equal fingerprints are one node. A bucket is searched inside a task, starting from one member after the other, and
sends one link per member that is reached, not its pairs; a bucket over ``TILE`` members is cut into parts, and every
two parts meet in a task, so that no task gets more than two parts and no link is lost.

Defined cases: NULL and empty texts have no shingle and fingerprint zero, and are linked like any other; a text of
fewer words than a shingle is one shingle; a NULL id is kept, and is never the name of a group that holds an id;
repeated rows share a group; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import ship
from threadlens.llm.components import connected_components
from threadlens.sources.sinks import store

#: Members of one part of a bucket.
TILE = 20_000
#: Shingles whose bits are counted at once; bounds the memory of a worker.
_COUNTED = 100_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a text in lower case (A-Z only), repeats included."""
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    n = max(1, len(found) - words + 1)
    shingles = map(b" ".join, zip(*[found[k:] for k in range(words)])) if len(found) >= words else [b" ".join(found)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in over half of the hashes; zero if there are none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _COUNTED):
        part = hashes[at : at + _COUNTED].astype(">u8").view(np.uint8)
        counts += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_key`` (a hash of the text) and ``fingerprint`` (64 bits as a long) of every document."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([majority(shingle_hashes(t.as_py(), words)) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["id", "text_key", "fingerprint"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, text_key long, fingerprint long")


def block_keys(fingerprint: Column, blocks: int, distance: int) -> Column:
    """One key for every choice of ``blocks - distance`` blocks: the number of the choice and the bits in them."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fingerprint, cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)) for k in range(blocks)]
    keys = [F.struct(F.lit(n).alias("choice"), F.xxhash64(*[parts[k] for k in chosen]).alias("bits")) for n, chosen in enumerate(combinations(range(blocks), blocks - distance))]
    return F.array(*keys)


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks whose keys hold about 16 of ``n`` fingerprints or fewer. Any number finds the same links."""
    blocks = distance + 2
    while n >> (64 * (blocks - distance) // blocks) > 16 and blocks < distance + 5:
        blocks += 1
    return blocks


def spanning_links(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the members as far as distances up to ``distance`` do, one less than each component has."""
    left, links = members, []
    while len(left) > 1:
        found, left = [int(left[0])], left[1:]
        while found and len(left):
            near = np.bitwise_count(left ^ np.uint64(at := found.pop())) <= distance
            if near.any():
                reached = left[near].tolist()
                links += [(at, other) for other in reached]
                found += reached
                left = left[~near]
    return links


def link_fingerprints(distinct: DataFrame, distance: int = 4, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Links a, b between different values of the column ``fingerprint``, enough to give their components."""
    blocks = blocks or blocks_for(distinct.count(), distance)
    keyed = distinct.select("fingerprint", F.explode(block_keys(F.col("fingerprint"), blocks, distance)).alias("key")).select("fingerprint", "key.*")
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / tile).cast("int")
    own = F.pmod(F.xxhash64("fingerprint", F.lit(7)), parts).cast("int")
    met = F.transform(F.sequence(F.lit(0), parts - 1), lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high")))
    groups = (keyed.join(sizes, ["choice", "bits"])
              .select("fingerprint", "choice", "bits", F.explode(met).alias("part"))
              .groupBy("choice", "bits", "part").agg(F.collect_list("fingerprint").alias("members")).select("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            links = [x for s, e in zip(ends[:-1], ends[1:]) for x in spanning_links(values[s:e], distance)]
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b))], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def near_duplicate_groups(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_key``, ``fingerprint`` and ``component_id``, the smallest id that is reached over links."""
    prints = store(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = store(prints.groupBy("fingerprint").agg(F.min("id").alias("first")), "distinct")
    reached = connected_components(link_fingerprints(distinct, distance))
    named = distinct.join(reached.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    groups = named.join(names, "component").select("fingerprint", "component_id", F.col("component").alias("group"))
    return prints.join(groups, "fingerprint")


def fingerprint_hex(fingerprint: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def drop_near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays (NULL last).

    Of rows that repeat an id and a text one stays. The choice is a minimum per group, built before the exchange.
    """
    groups = near_duplicate_groups(docs, words, distance, id_col, text_col)
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "text_key")).alias("best")).select(
        F.col("best.id").alias("__id"), F.col("best.text_key").alias("__key"))
    keyed = docs.withColumn("__text", F.xxhash64(docs[text_col]))
    kept = keyed.join(best, keyed[id_col].eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")))
    once = Window.partitionBy("__id", "__key").orderBy(F.lit(0))
    return kept.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*[kept[c] for c in docs.columns])
