"""Spelling variants of words: an index of grams of variable length, merged by bounds on the grams that an edit affects.

A gram dictionary is built from the words: all grams of ``SHORTEST`` letters, and every gram that is longer by one letter
as long as the shorter one is frequent (more than ``frequent`` places), up to ``LONGEST`` letters. A word, between marks
for its start and end, is decomposed at every place into the longest gram that the dictionary holds. An edit of one letter
can change only the grams that cover its place, so a word shares all its grams but ``affected`` (the most that cover one
place) with every word one edit away. Of two such words the rarest grams that stay are then among the rarest
``affected + 1`` of both: only these short lists are merged, and each pair that meets is verified.

A list belongs to a gram, its place and a length: words of that length at that place, and words longer by one at that
place or the next. Grams are never longer than the shortest word, so every word keeps grams that an edit does not
affect, and no pair is lost. Lists of more than ``tile`` words are cut into parts, and every two parts meet in
a task; a task verifies its pairs and sends those that are near, so pairs of a list are never rows.

Defined cases: NULL and empty texts have no words; a NULL id counts as the empty string in the draw of slips; repeated
rows count again; very long runs of letters are words like any other; ties go to the smallest word in code-point order; an
empty table gives no rows; only id and text are read, whatever the other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import ship
from threadlens.sources.sinks import store

SHORTEST = 2
LONGEST = 5
#: Places of a gram beyond which it is made longer.
FREQUENT = 200
#: Words of one part of a list.
TILE = 500
#: Letters of words (a fixed value), and the marks around a word.
LETTERS = r"A-Za-zÀ-ÿ"
START, END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs that are verified at once.
_PAIRS = 400_000


def counted_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, slip: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: runs of letters in lower case (A-Z only) of at least ``min_length`` letters and ``min_count`` places.

    With ``slip`` one in so many runs of a document, by a checksum of id and run, loses a letter before it is counted.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    words = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("word"))
    if slip:
        drawn = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = F.pmod(F.col("h"), F.char_length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
        words = drawn.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("word")).alias("word"))
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _places(words: DataFrame, longest: int) -> DataFrame:
    """``word_id``, ``place`` and ``gram`` (the next ``longest`` letters) for every place of every marked word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                ids, places, grams = [], [], []
                for word_id, word in zip(*[c.to_pylist() for c in batch.slice(at, 2000).columns]):
                    marked = START + word + END
                    n = len(marked) - SHORTEST + 1
                    ids += [word_id] * n
                    places += range(n)
                    grams += [marked[p : p + longest] for p in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(grams, pa.string())], ["word_id", "place", "gram"])

    return words.select("word_id", "word").mapInArrow(run, "word_id long, place int, gram string")


def decomposed(words: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT) -> DataFrame:
    """``word_id`` and ``grams``: an array of (times, gram, place), the rarest first, for words (word_id, word)."""
    places = store(_places(words, longest), "places")
    lengths = F.sequence(F.lit(SHORTEST), F.char_length("gram"))
    grams = places.select(F.explode(F.transform(lengths, lambda q: F.col("gram").substr(F.lit(1), q))).alias("gram"))
    times = store(grams.groupBy("gram").agg(F.count("*").alias("times")), "gram-counts")
    taken, size = places, F.lit(SHORTEST)
    going = F.lit(True)
    for q in range(SHORTEST, longest):
        # The dictionary's frequent grams of one length; Spark broadcasts them if they are few enough.
        level = times.where((F.char_length("gram") == q) & (F.col("times") > frequent)).select(F.col("gram").alias(f"g{q}"))
        taken = taken.join(level, F.col("gram").substr(1, q) == F.col(f"g{q}"), "left")
        going = going & F.col(f"g{q}").isNotNull() & (F.char_length("gram") > q)
        size = size + F.when(going, 1).otherwise(0)
    chosen = taken.select("word_id", "place", F.col("gram").substr(F.lit(1), size).alias("gram"))
    return chosen.join(times, "gram").groupBy("word_id").agg(F.sort_array(F.collect_list(F.struct("times", "gram", "place"))).alias("grams"))


def affected(places: np.ndarray, sizes: np.ndarray) -> int:
    """The most grams that cover one place: so many an edit of one letter can change."""
    edges = np.zeros(int((places + sizes).max()) + 1, int)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + sizes, -1)
    return int(np.cumsum(edges).max())


def _list_rows(words: DataFrame) -> DataFrame:
    """``gram``, ``place``, ``length``, ``long``, ``word``, ``n``: a word in the lists of its rarest grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for word, n, grams in zip(*[c.to_pylist() for c in batch.columns]):
                places = np.array([g["place"] for g in grams])
                count = affected(places, np.array([len(g["gram"]) for g in grams])) + 1
                rows = {(g["gram"], g["place"], len(word), False) for g in grams[:count]}
                rows |= {(g["gram"], g["place"] - shift, len(word) - 1, True) for g in grams[:count] for shift in (0, 1)}
                for row in rows:
                    for column, value in zip(out, (*row, word, n)):
                        column.append(value)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["gram", "place", "length", "long", "word", "n"])

    return words.select("word", "n", "grams").mapInArrow(run, "gram string, place int, length int, long boolean, word string, n long")


def near(first: np.ndarray, second: np.ndarray, longer: bool) -> np.ndarray:
    """Whether words (rows of code points, padded with zeros) are one edit apart; ``longer``: the first has a letter more."""
    if not longer:
        return (first != second).sum(axis=1) == 1
    differ, width = first != second, first.shape[1]
    start = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    moved = first[:, 1:] != second[:, :-1]
    last = np.where(moved.any(axis=1), width - 1 - moved[:, ::-1].argmax(axis=1), 0)
    return last <= start


def _crossed(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(left, len(right)), np.tile(right, len(left))


def _verified(lists: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Near pairs (a, n_a, b, n_b) of a batch of lists (own, members)."""
    ends = np.concatenate([[0], np.cumsum(lists.column(1).value_lengths().to_numpy())])
    high, long, word, n = lists.column(1).flatten().flatten()
    high, long, n = (c.to_numpy(zero_copy_only=False) for c in (high, long, n))
    own, lengths = lists.column(0).to_pylist(), pa.compute.utf8_length(word).to_numpy()
    waiting: list[tuple[bool, np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        for longer in (False, True):
            pairs = [(a, b) for kind, a, b in waiting if kind == longer]
            if not pairs:
                continue
            a, b = (np.concatenate(side) for side in zip(*pairs))
            # Words of like length together, so that a single very long one does not widen all rows.
            order = np.argsort(lengths[a], kind="stable")
            a, b = a[order], b[order]
            at = 0
            while at < len(a):
                width = int(lengths[a[at]]) + 1
                while True:
                    stop = min(len(a), at + max(1, 4 * _PAIRS // width))
                    widest = int(lengths[a[stop - 1]]) + 1
                    if widest <= 2 * width or stop == at + 1:
                        break
                    width = widest
                used, place = np.unique(np.concatenate([a[at:stop], b[at:stop]]), return_inverse=True)
                texts = np.array(word.take(pa.array(used)).to_pylist(), dtype=f"<U{widest}").view(np.uint32).reshape(len(used), widest)
                hits = at + np.flatnonzero(near(texts[place[: stop - at]], texts[place[stop - at :]], longer))
                if len(hits):
                    yield pa.RecordBatch.from_arrays([word.take(pa.array(a[hits])), pa.array(n[a[hits]]), word.take(pa.array(b[hits])), pa.array(n[b[hits]])], ["a", "n_a", "b", "n_b"])
                at = stop
        waiting.clear()

    held = 0
    for k, (start, stop) in enumerate(zip(ends[:-1], ends[1:])):
        rows = np.arange(start, stop)
        short, tall = rows[~long[start:stop]], rows[long[start:stop]]
        if own[k]:
            i, j = np.triu_indices(len(short), 1)
            met = [(False, short[i], short[j]), (True, *_crossed(tall, short))]
        else:
            first, second = (short[high[short] == side] for side in (False, True))
            met = [(False, *_crossed(first, second))] + [(True, *_crossed(tall[high[tall] == side], short[high[short] != side])) for side in (False, True)]
        waiting += [m for m in met if len(m[1])]
        held += sum(len(m[1]) for m in met)
        if held > _PAIRS:
            yield from flush()
            held = 0
    yield from flush()


def near_pairs(words: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT, tile: int = TILE) -> DataFrame:
    """``a``, ``n_a``, ``b``, ``n_b``: every pair of words (word, n; told apart by ``word``) that differ by one edit, once."""
    ship(words.sparkSession)
    named = store(words.select(F.monotonically_increasing_id().alias("word_id"), "word", "n"), "words")
    least = named.agg(F.min(F.char_length("word"))).first()[0] or longest
    if least < SHORTEST + 1:
        raise ValueError(f"words of fewer than {SHORTEST + 1} letters have no gram that every edit spares")
    grams = decomposed(named, min(longest, least), frequent)
    keyed = store(_list_rows(named.join(grams, "word_id")), "lists")
    key = ["gram", "place", "length"]
    crowded = keyed.groupBy(*key).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")).where("parts > 1")
    dealt = keyed.join(crowded, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("word", F.lit(7)), F.col("parts")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least(F.col("part"), other).alias("low"), F.greatest(F.col("part"), other).alias("high")))
    tiles = dealt.withColumn("part", part).select(*key, F.explode(met).alias("tile"), "part", "long", "word", "n")
    member = F.struct((F.col("part") > F.col("tile.low")).alias("upper"), "long", "word", "n")
    lists = tiles.groupBy(*key, "tile").agg(F.collect_list(member).alias("members"), F.min("long").alias("all_long")).where("size(members) > 1 AND NOT all_long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _verified(batch)

    found = lists.select((F.col("tile.low") == F.col("tile.high")).alias("own"), "members").mapInArrow(run, "a string, n_a long, b string, n_b long")
    swap = F.col("a") > F.col("b")
    ends = {"a": ("b", "a"), "n_a": ("n_b", "n_a"), "b": ("a", "b"), "n_b": ("n_a", "n_b")}
    return found.select(*[F.when(swap, F.col(x)).otherwise(F.col(y)).alias(name) for name, (x, y) in ends.items()]).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the last word that is reached from ``word`` over ``form`` (columns word, form; no circles).

    Every round doubles the steps that are taken, and is stored.
    """
    now = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        joined = now.join(onward, "root", "left")
        after = store(joined.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_groups(words: DataFrame, dominance: int = 5, longest: int = LONGEST, frequent: int = FREQUENT, tile: int = TILE) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for counted words (word, n).

    The form of a word is its near word of the largest count, if that is at least ``dominance`` times its own.
    """
    words = store(words.select("word", "n"), "counted")
    pairs = store(near_pairs(words, longest, frequent, tile), "near-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    dominant = -F.col("best.less") >= dominance * F.col("n")
    formed = store(best.select("word", "n_near", F.when(dominant, F.col("best.other")).alias("form"), F.when(dominant, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(formed.where("form IS NOT NULL"))
    out = words.join(formed, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
