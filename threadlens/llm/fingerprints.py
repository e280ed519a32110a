"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the ``k`` smallest distinct hashes of the word shingles of a text (48 bits each). Sketches of parts
merge into the sketch of the whole. Two sketches estimate the resemblance (Jaccard) of the shingle sets, the
containment of one in the other and the number of distinct shingles; below ``k`` shingles the estimates are exact.

As text, a fingerprint is the sorted hashes, 8 characters of base64 each, so equal texts have equal fingerprints.

Defined cases: NULL and empty texts have the empty fingerprint; two empty ones resemble each other by 1, an empty and
another one by 0; a text of fewer words than a shingle is one shingle; repeated rows have equal fingerprints; an empty
table gives no rows; only id and text are read. Words are split at ASCII white space, A-Z are taken as a-z.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import partitions_of, ship

#: Hashes of a fingerprint: the standard error of a resemblance is below 1 / (2 * sqrt(k)).
K = 128
WORDS = 5
_BITS = 48
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 over the golden ratio, made odd


def shingle_sketch(text: str | None, words: int = WORDS, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct shingle hashes, sorted."""
    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    of_word = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = max(1, len(found) - words + 1)
    mixed = np.zeros(n, np.uint64)
    for at in range(min(words, len(found))):
        mixed = (mixed ^ of_word[at : at + n]) * _ODD
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed * _ODD) >> np.uint64(64 - _BITS)
    if n > 4 * k:  # all copies of the k smallest values are below the k-th distinct one
        bound = np.partition(mixed, 2 * k)[2 * k]
        few = np.unique(mixed[mixed <= bound])
        if len(few) >= k:
            return few[:k]
    return np.unique(mixed)[:k]


def to_text(sketch: np.ndarray) -> str:
    """Base64 of the hashes, 6 bytes each."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    """The hashes of a fingerprint."""
    six = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(six), 2), np.uint8), six]).view(">u8").ravel().astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the k smallest hashes of the union that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**_BITS / float(a[-1] + np.uint64(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_count(np.union1d(a, b)[:k], k)
    return min(1.0, both / distinct_count(a, k))


def fingerprint_documents(docs: DataFrame, words: int = WORDS, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``fingerprint`` and ``n_shingles`` (estimated distinct shingles) of every document; no exchange."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [shingle_sketch(t.as_py(), words, k) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(to_text, sketches), pa.string()), pa.array([distinct_count(s, k) for s in sketches], pa.float64())], ["id", "fingerprint", "n_shingles"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, fingerprint string, n_shingles double")


def merge_fingerprints(prints: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One fingerprint for each value of ``by``: that of all its texts together.

    The hashes are made distinct per group, then the k smallest are kept by a ranked limit. Spark applies both before
    the exchange too, so a group that holds a third of all rows sends at most k rows per task to the last step.
    """
    one = F.regexp_extract_all("fingerprint", F.lit(".{8}"), 0)
    hashes = prints.select(*by, F.explode(F.when(F.col("fingerprint") != "", one).otherwise(F.array(F.lit("")))).alias("hash")).distinct()
    order = F.hex(F.unbase64("hash"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy((F.col("hash") == "").cast("int"), order))
    kept = hashes.withColumn("place", place).where(F.col("place") <= k)
    return kept.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "hash"))), lambda s: s["hash"]), "").alias("fingerprint"))


def compare_fingerprints(a: Column, b: Column, k: int = K) -> Column:
    """Struct of resemblance, containment (of ``a`` in ``b``) of two fingerprint columns."""
    @F.pandas_udf("resemblance double, containment double")
    def compare(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        pairs = [(from_text(x), from_text(y)) for x, y in zip(left, right)]
        return pd.DataFrame({"resemblance": [resemblance(x, y, k) for x, y in pairs], "containment": [containment(x, y, k) for x, y in pairs]})

    return compare(a, b)


def _constants(values: list, kind: str) -> Column:
    """A constant array."""
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _range_of(value: Column, cuts: list) -> Column:
    """How many of the sorted cut points are not above the value: first by every k-th of them, then inside the block."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts)) + 1
    blocks = [cuts[at : at + size] for at in range(0, len(cuts), size)]
    block = F.size(F.filter(F.array(*[F.lit(b[0]) for b in blocks]), lambda c: c <= value))
    inside = F.size(F.filter(F.get(F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks]), block - 1), lambda c: c <= value))
    return F.when(block == 0, 0).otherwise((block - 1) * size + inside)


def edit_study(docs: DataFrame, words: int = WORDS, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How the fingerprint of every text stands to that of an edited text and to that of the next document.

    The edited text has its last ``n_chars // 2`` characters replaced by the first as many of the next document in
    the order of ids (NULL first, then by text); after the last comes the first. One exchange deals the texts out by
    ranges of ids. The rows that begin a range are also sent to the range before, so each task streams its rows in
    order and knows every successor; a task holds two texts at a time. Cut points and first ids (as many as ranges)
    are all that reaches the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = 4 * partitions_of(spark)
    ids = docs.select(F.col(id_col).alias("id"))
    kind = ids.schema["id"].dataType.simpleString()
    fractions = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = sorted(set(ids.agg(F.percentile_approx("id", fractions, F.lit(100 * parts))).first()[0] or []))
    part = F.when(F.col("id").isNull(), 0).otherwise(_range_of(F.col("id"), cuts))
    firsts = ids.withColumn("part", part).groupBy("part").agg(F.min("id").alias("first"), F.count_if(F.col("id").isNull()).alias("nulls")).orderBy("part").collect()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("part", part)
    earlier, begin = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for place, row in enumerate(firsts):
        earlier[row["part"]], begin[row["part"]] = firsts[place - 1]["part"], row["first"]
    nulls = bool(firsts) and firsts[0]["nulls"] > 0
    begins = F.when(F.col("part") == 0, F.col("id").isNull()).otherwise(F.lit(False)) if nulls else F.lit(False)
    begins |= (F.col("id") == F.get(_constants(begin, kind), F.col("part"))) & ~((F.col("part") == 0) & F.lit(nulls))
    before = F.when(F.coalesce(begins, F.lit(False)), F.get(_constants(earlier, "int"), F.col("part")))
    places = F.array(F.struct(F.col("part").alias("at"), F.lit(0).alias("ahead")), F.struct(before.alias("at"), F.lit(1).alias("ahead")))
    dealt = (rows.select("id", "text", F.explode(F.filter(places, lambda p: p["at"].isNotNull())).alias("place"))
             .select("id", F.coalesce("text", F.lit("")).alias("text"), "place.*")
             .repartition(partitions_of(spark), "at").sortWithinPartitions("at", "ahead", F.col("id").asc_nulls_first(), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for id_, text, at, ahead in zip(*(c.to_pylist() for c in batch.columns)):
                sketch = shingle_sketch(text, words, k)
                if last and last[2] == at and not last[3]:
                    edit = edited_text(last[1], text)
                    changed = shingle_sketch(edit, words, k)
                    out.append((last[0], len(last[1]), edit, to_text(last[4]), to_text(changed), resemblance(last[4], changed, k), resemblance(last[4], sketch, k)))
                last = (id_, text, at, ahead, sketch)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, f"id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]
