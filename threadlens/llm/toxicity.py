"""Toxic passages: maximum-scoring segments over token log-odds, with extreme-value calibration.

Fitting. From labelled documents, every unit (a word, or the first 3 to 6 letters of a longer one) gets the log of the
ratio of its rates in toxic and in other documents, with a Dirichlet prior of ``PRIOR`` pseudo-counts that says "no
difference". Units with a z-score of ``Z`` or more make up the model. A word has the score of its longest unit in the
model, any other word the (slightly negative) log ratio of not being in the model.

Scoring. One pass finds all maximal scoring segments of a text. As scores are log ratios, the expected number of
passages of score S or more in m words of clean text is K * m * exp(-S); K is fitted on clean documents held back from
the counts. A passage is significant where that number is below ``SIGNIFICANT``. The passages of a text are brought
together as the sum of -log(expected number), at least that of the best one, and a logistic curve fitted on documents
held back turns it into a score from 0 to 1.

Labels are used by ``fit_toxicity`` only, on at most ``max_labelled`` rows (a documented bound; the rows with the
smallest hashes of their ids). Copies and near-copies, told by the smallest shingle hash, count once. The model has at
most ``max_units`` units. Scoring covers all rows and whole texts, and needs no exchange.

Defined cases: NULL and empty texts have no passage and the score of the intercept; repeated rows score alike; labels
that are NULL are not used, of several labels of an id the largest counts; without labels of both kinds every score is
0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.bpe import Memo
from threadlens.llm.common import ship
from threadlens.llm.fingerprints import shingle_sketch
from threadlens.sources.sinks import store

PRIOR = 5.0
Z = 3.0
SIGNIFICANT = 0.01
PREFIXES = (6, 5, 4, 3)
#: Bins of the evidence for the logistic fit.
_BIN = 0.25
_word = re.compile(r"[^\W_]+")


class ToxicityModel(NamedTuple):
    """Unit scores, score of any other word, K, and the intercept and slope of the logistic curve."""

    units: dict[str, float]
    other: float
    k: float
    intercept: float
    slope: float


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _word.findall((text or "").lower())


def units_of(word: str) -> list[str]:
    """The word and its beginnings, longest first; a beginning is marked by a star."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def unit_score(units: dict[str, float], word: str) -> float:
    """Score of the longest unit in the model, 0 if there is none."""
    return next((units[u] for u in units_of(word) if u in units), 0.0)


def maximal_segments(places: list[int], scores: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last place and score), in linear time.

    ``places`` and ``scores`` give the words with a positive score; each word between them scores ``other`` < 0. The
    list holds candidates with the sums before and after each; a new one swallows those from the last candidate
    that begins lower, if it ends higher.
    """
    found: list[list[float]] = []
    total, at = 0.0, -1
    for place, score in zip(places, scores):
        total += other * (place - at - 1)
        left, total, first = total, total + score, place
        right, at, last = total, place, place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4] if found[j][4] >= 0 else -1
            if j < 0 or found[j][3] >= right:
                found.append([first, last, left, right, j])
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(int(f), int(e), r - l) for f, e, l, r, _ in found]


def evidence(segments: list[tuple[int, int, float]], words: int, k: float) -> float:
    """Sum of -log(expected number) over significant passages, or that of the best passage."""
    if not segments:
        return -math.log(max(k * max(words, 1), 1e-300))
    logs = [s - math.log(k * words) for _, _, s in segments]
    return max(max(logs), sum(x for x in logs if x > -math.log(SIGNIFICANT)))


def _hits(units: dict[str, float]):
    """A function from words to the places and scores of those in the model."""
    memo = Memo(lambda word: unit_score(units, word) or -1.0, 100_000)

    def hits(words: list[str]) -> tuple[list[int], list[float]]:
        scores = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
        places = np.flatnonzero(scores > 0)
        return places.tolist(), scores[places].tolist()

    return hits


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, text, toxic of the labelled rows; the labels are bounded and so can be broadcast."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("known")).agg(F.max(label_col).alias("toxic"))
    few = known.orderBy(F.xxhash64("known"), "known").limit(max_labelled)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), F.col("id") == F.col("known")).drop("known")


def _once(rows: DataFrame) -> DataFrame:
    """id, toxic of one row for each smallest shingle hash and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [int(s[0]) if len(s := shingle_sketch(t.as_py(), 5, 1)) else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.int64())], ["id", "toxic", "key"])

    kinds = dict(rows.dtypes)
    keyed = rows.mapInArrow(run, f"id {kinds['id']}, toxic {kinds['toxic']}, key long")
    return keyed.groupBy("key", "toxic").agg(F.min("id").alias("id")).select(F.col("id").alias("known"), "toxic").distinct()


def _counts(rows: DataFrame) -> DataFrame:
    """unit, c1, c0: in how many toxic and other documents a unit is; each batch is counted before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = set(words_of(text))
                counts[bool(toxic)].update({u for w in words for u in units_of(w)})
                counts[bool(toxic)][""] += len(words)
            units = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), *(pa.array([c[u] for u in units], pa.int64()) for c in (counts[1], counts[0]))], ["unit", "c1", "c0"])

    return rows.mapInArrow(run, "unit string, c1 long, c0 long").groupBy("unit").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))


def log_odds(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """unit, score and z of every unit: log ratio of the rates with a Dirichlet prior, and it over its deviation."""
    share = n1 / (n1 + n0)
    a1, a0 = F.col("c1") + F.lit(PRIOR * share), F.col("c0") + F.lit(PRIOR * (1 - share))
    score = F.log(a1) - F.log(a0) - F.lit(math.log(n1) - math.log(n0))
    return counts.select("unit", score.alias("score"), (score / F.sqrt(1 / a1 + 1 / a0)).alias("z"))


def _logistic(x: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method on binned counts, with a weak prior on the slope."""
    a = b = 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = (n1 + n0) * p * (1 - p)
        g = n1 - (n1 + n0) * p
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.1]])
        step = np.linalg.solve(h, [g.sum(), (g * x).sum() - 0.1 * b])
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
    return float(a), max(0.0, float(b))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 200_000,
    max_units: int = 50_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """The model of the labelled rows (only those of ``labels``); a quarter of them, by hash, is held back to calibrate.

    What comes to the driver: two sums, the units of the model, and the counts of the evidence in bins.
    """
    ship(docs.sparkSession)
    none = ToxicityModel({}, -1.0, 1.0, -30.0, 0.0)
    chosen = store(_once(_labelled(docs, labels, max_labelled, id_col, text_col, label_col)), "chosen")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("known")).select("id", "text", "toxic")
    held = F.pmod(F.xxhash64(F.col("id"), F.lit("held")), 4) == 0
    counts = store(_counts(rows.where(~held)), "counts")
    sums = counts.where("unit = ''").first()
    if not sums or not sums["c1"] or not sums["c0"]:
        return none
    odds = log_odds(counts.where("unit <> '' AND c1 > 1"), sums["c1"], sums["c0"]).where(F.col("z") >= Z)
    units = {r["unit"]: r["score"] for r in odds.orderBy(F.desc("z"), "unit").limit(max_units).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _hits(shared.value)
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            places, scores = zip(*map(hits, words)) if words else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(2).cast(pa.int32()), pa.array(map(len, words), pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(scores, pa.list_(pa.float64()))], ["toxic", "words", "places", "scores"])

    held_back = store(rows.where(held).mapInArrow(sparse, "toxic int, words long, places array<int>, scores array<double>"), "held")
    shares = {r["toxic"]: (r["hits"] + 0.5) / (r["words"] + 1.0) for r in held_back.groupBy("toxic").agg(F.sum(F.size("places")).alias("hits"), F.sum("words").alias("words")).collect()}
    if len(shares) < 2:
        return none
    other = min(-1e-3, math.log1p(-shares[1]) - math.log1p(-shares[0]))

    def measured(k: float | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for n, places, scores in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                    segments = maximal_segments(places, scores, other)
                    out.append(evidence(segments, n, k) if k else n * math.exp(-max((s for _, _, s in segments), default=0.0)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["toxic", "value"])

        return held_back.mapInArrow(run, "toxic int, value double")

    clean = measured(None).where("toxic = 0").agg(F.count("*"), F.sum("value")).first()
    k = max(1e-12, clean[0] / clean[1]) if clean[1] else 1.0
    bins = measured(k).groupBy(F.round(F.greatest(F.lit(-50.0), F.least(F.lit(200.0), F.col("value"))) / _BIN).alias("bin")).agg(
        F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0")).orderBy("bin").collect()
    a, b = _logistic(np.array([r["bin"] for r in bins]) * _BIN, np.array([r["n1"] for r in bins], float), np.array([r["n0"] for r in bins], float))
    return ToxicityModel(units, other, k, a, b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``score`` (0 to 1) and the significant ``passages`` (first and end character, score, expected number)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hits = _hits(m.units)
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                segments = maximal_segments(*hits(words), m.other)
                z = m.intercept + m.slope * evidence(segments, len(words), m.k)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                real = [s for s in segments if m.k * len(words) * math.exp(-s[2]) < SIGNIFICANT]
                spans = [w.span() for w in _word.finditer(text.lower())] if real else []
                passages.append([{"start": spans[f][0], "end": spans[e][1], "score": s, "expected": m.k * len(words) * math.exp(-s)} for f, e, s in real])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, pa.list_(passage))], ["id", "score", "passages"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, score double, passages array<struct<start: int, end: int, score: double, expected: double>>")


def held_out(id_: Column) -> Column:
    """Whether labels of this id are kept from fitting: the CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns; fitted on labels that are not held out.

    The score is computed beside the row, so texts are not exchanged.
    """
    model = fit_toxicity(docs, labels.where(~held_out(F.col(id_col))), id_col=id_col, text_col=text_col)
    return docs.where(toxicity_score(docs.sparkSession, model)(docs[text_col]) < threshold)


def toxicity_score(spark, model: ToxicityModel):
    """The score as a column function."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        hits = _hits(m.units)
        for texts in parts:
            out = []
            for text in texts:
                words = words_of(text)
                z = m.intercept + m.slope * evidence(maximal_segments(*hits(words), m.other), len(words), m.k)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pd.Series(out, dtype="float64")

    return score
