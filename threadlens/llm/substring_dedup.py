"""Passages that repeat across documents: paragraph MinHash banding.

Paragraphs are cut by content: after every word whose hash is the least among ``RADIUS`` words on both sides (about 11
words each); of equal least words (repeated lines) those count that leave a paragraph of five words. A passage that is
copied into another text is therefore cut at the same places there, wherever it stands, and only the paragraphs at its
ends differ. A paragraph is the set of its shingles of five words; its MinHash values make ``bands`` keys of ``rows``
values each, tuned so that a pair at the threshold shares a key with the wanted probability. Colliding paragraphs are
joined by key, verified by their exact Jaccard similarity, and verified links make components. The paragraphs of the
first document of a component stay, the others are removals.

A paragraph whose neighbour does not repeat is extended to that side word by word, as far as three words in a row stand
at the same distance from a paragraph of its component in another document too; up to ``GAP`` words may be replaced, and up to ``REACH``
words are compared, more than a cut lies from the end of a passage but for some in ten thousand. Stretches at most ``GAP`` words
apart make a passage; it is reported if it is ``min_words`` long and at least ``threshold`` of so many words repeat (words
replaced inside an extension count).

Equal paragraphs are one node, and are collected once per batch before the exchange. Keys with up to ``FEW`` different
paragraphs give their pairs. Those of more go another way: their paragraphs are dealt out in tiles, every two tiles
of a key meet in a task, and the task searches from one member after the other and sends one link per member reached, not
its pairs. Shingle sets are only taken from texts for paragraphs that collide (told by a bitmap of fixed size, then
exactly), and the words beside a paragraph only for ends of stretches.

Defined cases: NULL and empty texts have no paragraph; paragraphs of fewer than five words are not compared; repeated
rows are reported once (the first by id, then by text, stays; NULL ids come last); repeats inside one document alone
are not passages across documents; very long texts are cut like others, a task holds one text at a time beside its
batch; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import ship, slices
from threadlens.llm.components import connected_components
from threadlens.sources.sinks import store

RADIUS = 5
WORDS = 5
#: Changed words inside a passage that are passed over.
GAP = 5
#: Words of the shortest part of a passage that is reported.
PART = 18
#: Words beside a paragraph that are compared.
REACH = 24
#: Different paragraphs of a key up to which their pairs are written.
FEW = 16
#: Members of a tile of a key with more.
TILE = 1000
#: Different surroundings of a side of a component up to which they meet in one task.
CROWD = 256
#: Bytes of texts that are worked on together.
SLICE = 1 << 20
#: Bits of the bitmap of colliding paragraphs: 4 MB whatever the data.
_SLOTS = 1 << 25
#: The bitmap comes to the driver in so many pieces.
_PIECES = 64
#: Which bytes are white space.
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 over the golden ratio, made odd
#: The primes of XXH64 (fixed values).
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
_MULTIPLIERS = np.array([int.from_bytes(xxhash.xxh64_digest(str(k)), "big") | 1 for k in range(256)], np.uint64)


def tune_bands(threshold: float = 0.8, recall: float = 0.98, rows: int = 2) -> int:
    """The fewest bands of ``rows`` values that bring a pair at the threshold together with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the place of each (and the end)."""
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[places[0] : places[-1]], places - places[0]


def word_places(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts begin and end, in bytes of all."""
    space, n = _SPACE[data], len(data)
    begins, ends = np.r_[True, space[:-1]][:n], np.r_[space[1:], True][:n]
    begins[places[places < n]] = True
    ends[places[places > 0] - 1] = True
    return np.flatnonzero(begins & ~space), np.flatnonzero(ends & ~space) + 1


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def xxh64(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of ranges of bytes; those of one length under 32 are worked on together, in steps of 8, 4 and 1 bytes."""
    one, two, three, four, five = _PRIMES
    room = np.r_[data, np.zeros(8, np.uint8)]
    eight, quad = (np.ndarray(len(data) + 1, kind, room, 0, (1,)) for kind in ("<u8", "<u4"))
    sizes = np.minimum(ends - begins, 32).astype(np.uint8)
    order, stops = np.argsort(sizes, kind="stable"), np.cumsum(np.bincount(sizes, minlength=33))
    out = np.zeros(len(begins), np.uint64)
    for size in range(1, 32):
        some = order[stops[size - 1] : stops[size]]
        if not len(some):
            continue
        at, k, x = begins[some], 0, np.full(len(some), five + np.uint64(size), np.uint64)
        for k in range(0, size - 7, 8):
            x = _turned(x ^ _turned(eight[at + k] * two, 31) * one, 27) * one + four
        k = size // 8 * 8
        if size - k >= 4:
            x = _turned(x ^ quad[at + k].astype(np.uint64) * one, 23) * two + three
            k += 4
        for k in range(k, size):
            x = _turned(x ^ room[at + k].astype(np.uint64) * five, 11) * one
        x = (x ^ x >> np.uint64(33)) * two
        x = (x ^ x >> np.uint64(29)) * three
        out[some] = x ^ x >> np.uint64(32)
    for k in order[stops[31] :].tolist():
        out[k] = xxhash.xxh64_intdigest(data[begins[k] : ends[k]])
    return out


def word_hashes(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: hashes of their words, in lower case, how many words come before each text (and the end), and where words begin and
    end, in bytes of all."""
    begins, ends = word_places(data, places)
    return xxh64(np.frombuffer(data.tobytes().lower(), np.uint8), begins, ends), np.searchsorted(begins, places), begins, ends


def first_words(h: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The first word of every paragraph of all texts, and the end."""
    sizes = np.diff(upto)
    # words that are never less stand between the texts
    at = np.arange(len(h)) + RADIUS * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    apart = np.full(len(h) + RADIUS * (len(sizes) + 1), np.iinfo(np.uint64).max, np.uint64)
    apart[at] = h
    inner = apart[RADIUS : len(apart) - RADIUS]
    least = np.ones(len(inner), bool)
    for k in range(1, RADIUS + 1):
        least &= inner <= apart[RADIUS - k : len(apart) - RADIUS - k]
        least &= inner <= apart[RADIUS + k : len(apart) - RADIUS + k]
    least = least[at - RADIUS]
    least[upto[1:][sizes > 0] - 1] = False
    cuts = np.flatnonzero(least) + 1
    text = np.searchsorted(upto, cuts, "right")
    near = (np.diff(cuts) < WORDS) & (text[1:] == text[:-1])
    if near.any():  # equal words near each other
        kept, wrong = np.ones(len(cuts), bool), np.unique(text[1:][near])
        for begin, end in zip(np.searchsorted(text, wrong).tolist(), np.searchsorted(text, wrong, "right").tolist()):
            last = -WORDS
            for k, place in enumerate((cuts[begin:end] - upto[text[begin] - 1]).tolist(), begin):
                if place - last >= WORDS:
                    last = place
                else:
                    kept[k] = False
        cuts = cuts[kept]
    return np.r_[np.sort(np.r_[upto[:-1][sizes > 0], cuts]), len(h)]


def all_paragraphs(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts: first word of each paragraph (and the end) among the words of all, hash of each paragraph, all shingle hashes, the
    place of the first shingle of each paragraph (and the end), and what ``word_hashes`` gives beside the hashes; paragraphs of fewer
    than five words have no shingle."""
    h, *words = word_hashes(data, places)
    upto = words[0]
    bounds, n = first_words(h, upto), len(h)
    first, sizes = bounds[:-1], np.diff(bounds)
    inside = np.arange(n) - np.repeat(first, sizes)
    whole = np.add.reduceat(_mixed(h ^ _mixed(inside.astype(np.uint64) + np.uint64(1))), first) if n else h
    rolled = h.copy()
    for k in range(1, WORDS if n >= WORDS else 1):
        rolled[: n - k] = _mixed(rolled[: n - k] ^ np.uint64(k)) + h[k:]
    full = inside < np.repeat(np.maximum(sizes - WORDS + 1, 0), sizes)
    return bounds, whole, _mixed(rolled[full]), np.r_[0, np.cumsum(np.maximum(sizes - WORDS + 1, 0))], *words


def paragraphs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first four of these for one text."""
    return all_paragraphs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[:4]


def windows(h: np.ndarray, starts: np.ndarray, step: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start a hash of each of ``REACH`` words from there on (backwards with ``step`` -1) with the two words before it, and
    how many of these words its text has, whose words are those from ``low`` to before ``high``."""
    at = starts[:, None] + step * np.arange(-2, REACH)
    there = (at >= low[:, None]) & (at < high[:, None])
    near = h[np.clip(at, low[:, None], high[:, None] - 1)]
    values = near[:, 2:] + _mixed(near[:, 1:-1] + _mixed(near[:, :-2]))
    return _mixed(values).astype(np.uint32), there[:, 2:].sum(axis=1)


def text_keys(data: np.ndarray, places: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The keys of some texts."""
    return np.fromiter((xxhash.xxh64_intdigest(data[places[k] : places[k + 1]]) >> 1 for k in which.tolist()), np.uint64, len(which))


def sorted_sets(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """The different values of each range, in order. Ranges of the same size are sorted together."""
    bounds = np.r_[0, np.cumsum(sizes)]
    out, kept = np.zeros(bounds[-1], np.uint64), np.ones(bounds[-1], bool)
    for size in np.unique(sizes).tolist():
        some, inside = np.flatnonzero(sizes == size), np.arange(size)
        rows, at = np.sort(values[starts[some][:, None] + inside], axis=1), bounds[some][:, None] + inside
        out[at] = rows
        kept[at[:, 1:]] = rows[:, 1:] != rows[:, :-1]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)][bounds].astype(np.int32)), pa.array(out[kept].view(np.int64)))


def band_keys(shingles: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One line per paragraph with shingles, one key per band."""
    values = [np.minimum.reduceat(_mixed(shingles * m), starts) for m in _MULTIPLIERS[: bands * rows]]
    keys = []
    for b in range(bands):
        key = np.full(len(starts), b, np.uint64)
        for v in values[b * rows : (b + 1) * rows]:
            key = _mixed(key ^ v)
        keys.append(key)
    return np.stack(keys, axis=1)


def banded(docs: DataFrame, bands: int, rows: int, text_col: str = "text") -> DataFrame:
    """key, paragraph, times: the keys of every paragraph, counted in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, wholes = [np.zeros((0, bands), np.uint64)], [np.zeros(0, np.uint64)]
            texts = pc.fill_null(batch.column(0), "")
            for at, n in slices(texts, SLICE):
                _, whole, shingles, starts, *_ = all_paragraphs(*text_bytes(texts.slice(at, n)))
                some = np.diff(starts) > 0
                if some.any():
                    keys.append(band_keys(shingles, starts[:-1][some], bands, rows))
                    wholes.append(whole[some])
            whole, at, times = np.unique(np.concatenate(wholes), return_index=True, return_counts=True)
            key = np.concatenate(keys)[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(whole, bands).view(np.int64)), pa.array(np.repeat(np.minimum(times, 2), bands).astype(np.int32))],
                ["key", "paragraph", "times"])

    return docs.select(text_col).mapInArrow(run, "key long, paragraph long, times int")


def collisions(keyed: DataFrame) -> DataFrame:
    """a, b, crowded: pairs of paragraphs with a common key (a = b: found more than once); of a key with more than
    ``FEW`` paragraphs the rows (key, paragraph, true) instead. Rows stream through in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, crowd, out = None, {}, False, []

        def close() -> None:
            names = sorted(members)
            if crowd:
                out.extend((key, m, True) for m in names)
            else:
                out.extend((a, b, False) for i, a in enumerate(names) for b in names[i + 1 :])
            out.extend((m, m, False) for m in names if members[m] > 1)

        for batch in batches:
            keys, names, times = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            new = np.r_[True, keys[1:] != keys[:-1]]
            alone = new & np.r_[new[1:], False] & (times == 1)  # the last row of a batch may go on in the next
            if len(alone):
                alone[0] &= keys[0] != key
            for k, name, n in zip(keys[~alone].tolist(), names[~alone].tolist(), times[~alone].tolist()):
                if k != key:
                    close()
                    key, members, crowd = k, {}, False
                elif len(members) > FEW and name not in members:  # equal paragraphs follow each other: these are done
                    crowd = True
                    close()
                    members = {}
                members[name] = members.get(name, 0) + n
            yield _links(out)
        close()
        yield _links(out)

    def _links(out: list) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], ["a", "b", "crowded"])

    return keyed.repartition("key").sortWithinPartitions("key", "paragraph").mapInArrow(run, "a long, b long, crowded boolean")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Which of ``_SLOTS`` slots the column ``key`` takes. Tasks pack the bits into ``_PIECES`` blocks, all that comes to the driver."""
    slot = F.col("key").bitwiseAND(F.lit(_SLOTS - 1))
    size = _SLOTS // 32 // _PIECES
    words = keys.groupBy(F.floor(slot / 32).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((key & {_SLOTS - 1}) % 32 as int))")).alias("bits"))

    def pack(rows: pa.Table) -> pa.Table:
        word, out = rows["word"].to_numpy(), np.zeros(size, np.uint32)
        out[word % size] = rows["bits"].to_numpy().astype(np.uint32)
        return pa.table({"piece": [int(word[0]) // size], "bits": [out.tobytes()]})

    taken = np.zeros((_PIECES, size), np.uint32)
    for piece, bits in words.groupBy(F.floor(F.col("word") / size)).applyInArrow(pack, "piece long, bits binary").collect():
        taken[piece] = np.frombuffer(bits, np.uint32)
    return taken.ravel()


def _taken(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys hit a slot that is taken."""
    slots = keys & np.uint64(_SLOTS - 1)
    return (bitmap[slots >> np.uint64(5)] >> (slots & np.uint64(31)).astype(np.uint32) & 1).astype(bool)


def occurrences(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """paragraph, id, text_key, number, start, end, first, words, shingles of the paragraphs in ``wanted``, wherever they occur.

    Places are in bytes of UTF-8. The texts are cut again; what the bitmap lets through is checked by a join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.withColumnRenamed("paragraph", "key")))
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = shared.value
        for batch in batches:
            all_texts = pc.fill_null(batch.column(1), "")
            for at, n in slices(all_texts, SLICE):
                data, places = text_bytes(all_texts.slice(at, n))
                bounds, whole, shingles, starts, upto, begins, ends = all_paragraphs(data, places)
                sizes = np.diff(starts)
                hit = np.flatnonzero(_taken(taken, whole) & (sizes > 0))
                if not len(hit):
                    continue
                first, after = bounds[hit], bounds[hit + 1]
                text = np.searchsorted(upto, first, "right") - 1
                some, row = np.unique(text, return_inverse=True)
                columns = [(begins[first] - places[text]), (ends[after - 1] - places[text]), first - upto[text], after - first]
                number = hit - np.searchsorted(bounds, upto[text])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole[hit].view(np.int64)), batch.column(0).slice(at, n).take(pa.array(text)), pa.array(text_keys(data, places, some)[row].view(np.int64)),
                     *[pa.array(c.astype(np.int32)) for c in (number, *columns)], sorted_sets(shingles, starts[hit], sizes[hit])],
                    ["paragraph", "id", "text_key", "number", "start", "end", "first", "words", "shingles"])

    kind = picked.schema["id"].dataType.simpleString()
    found = picked.mapInArrow(run, f"paragraph long, id {kind}, text_key long, number int, start int, end int, first int, words int, shingles array<long>")
    return found.join(wanted, "paragraph", "left_semi")


def spanning_links(names: list[int], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that join the members as far as similarities of the threshold or more do, one less than each component has. A member is
    compared with those that have a value in common, by an index of the members of each value."""
    sizes = np.array([len(s) for s in sets])
    _, values = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.r_[0, np.cumsum(sizes)]
    left, links = np.ones(len(sets), bool), []

    def index() -> tuple[np.ndarray, np.ndarray, int]:
        owner, some = np.repeat(np.arange(len(sets)), sizes * left), values[np.repeat(left, sizes)]
        return owner[np.argsort(some, kind="stable")], np.r_[0, np.cumsum(np.bincount(some, minlength=len(values)))], left.sum()

    members, places, inside = index()
    for begin in range(len(sets)):
        found = [begin] if left[begin] else []
        left[begin] = False
        while found and inside:
            at = found.pop()
            own = values[bounds[at] : bounds[at + 1]]
            other, both = np.unique(np.concatenate([members[places[v] : places[v + 1]] for v in own.tolist()]), return_counts=True)
            near = other[left[other] & (both >= threshold * (sizes[other] + sizes[at] - both) - 1e-9)]
            reached = near.tolist()
            links += [(names[at], names[k]) for k in reached]
            found += reached
            left[near] = False
            if reached and 2 * left.sum() < inside:  # go on with the sets that are left
                members, places, inside = index()
    return links


def verified_links(found: DataFrame, sets: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """a, b: the collisions whose exact Jaccard similarity reaches the threshold."""
    other = sets.select(F.col("paragraph").alias("b"), F.col("shingles").alias("of_b"))
    pairs = found.where("NOT crowded AND a <> b").select("a", "b").distinct()
    joined = pairs.join(sets.withColumnRenamed("paragraph", "a"), "a").join(other, "b")
    both = F.size(F.array_intersect("shingles", "of_b"))
    near = joined.where(both >= F.lit(threshold) * (F.size("shingles") + F.size("of_b") - both) - F.lit(1e-9)).select("a", "b")
    crowded = found.where("crowded").select(F.col("a").alias("key"), F.col("b").alias("paragraph")).distinct()
    sizes = crowded.groupBy("key").agg(F.count("*").alias("members"))
    parts = F.ceil(F.col("members") / tile).cast("int")
    own = F.pmod(F.xxhash64("paragraph"), parts).cast("int")
    met = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(own, o).alias("low"), F.greatest(own, o).alias("high")))
    groups = (crowded.join(sizes, "key").select("key", "paragraph", F.explode(met).alias("part")).join(sets, "paragraph")
              .groupBy("key", "part").agg(F.collect_list(F.struct("paragraph", "shingles")).alias("m")).select("m.paragraph", "m.shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for names, shingles in zip(batch.column(0).to_pylist(), batch.column(1)):
                stops = np.cumsum(shingles.values.value_lengths().to_numpy())
                links += spanning_links(names, np.split(shingles.values.flatten().to_numpy(), stops[:-1]), threshold)
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return near.unionByName(groups.mapInArrow(run, "a long, b long"))


def _several(keyed: DataFrame, key: str) -> DataFrame:
    """The keys found in more than one document, with the first of these."""
    late = F.struct(F.col("id").isNull().alias("late"), "id", "text_key")
    counted = keyed.groupBy(key).agg(F.min(late).alias("one"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_if(F.col("id").isNull()).alias("nulls"))
    return counted.where("low < high OR (low IS NOT NULL AND nulls > 0) OR nulls > 1").select(key, "one")


def beside(docs: DataFrame, ends: DataFrame, text_col: str = "text") -> DataFrame:
    """text_key, number, side, windows, bytes: the words before (side 0) or after (1) the paragraphs in ``ends``, as hashes of three words
    each and how many bytes away each begins (ends). Only texts with ends are cut again, equal ones once a task."""
    context = docs.sparkSession.sparkContext
    some_text = context.broadcast(_bitmap(ends.select(F.col("text_key").alias("key"))))
    some_end = context.broadcast(_bitmap(ends.select(F.col("text_key").bitwiseXOR(F.col("number").cast("long") * 2 + F.col("side")).alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # eight bytes for a text of the task that has ends
        for batch in batches:
            all_texts = pc.fill_null(batch.column(0), "")
            for at, n in slices(all_texts, SLICE):
                data, places = text_bytes(all_texts.slice(at, n))
                keys, once = np.unique(text_keys(data, places, np.arange(n)), return_index=True)
                some = _taken(some_text.value, keys)
                some[some] = [key not in seen for key in keys[some].tolist()]
                if not some.any():
                    continue
                keys, texts = keys[some], all_texts.slice(at, n).take(pa.array(once[some]))
                seen.update(keys.tolist())
                h, upto, begins, ends = word_hashes(*text_bytes(texts))
                bounds = first_words(h, upto)
                text = np.searchsorted(upto, bounds[:-1], "right") - 1
                number = np.arange(len(text)) - np.searchsorted(bounds, upto[text])
                for side in (0, 1):
                    wanted = np.flatnonzero(_taken(some_end.value, keys[text] ^ (number.astype(np.uint64) * np.uint64(2) + np.uint64(side))))
                    starts, step = (bounds[wanted + 1], 1) if side else (bounds[wanted] - 1, -1)
                    values, sizes = windows(h, starts, step, upto[text[wanted]], upto[text[wanted] + 1])
                    wanted, starts, values, sizes = (x[sizes > 0] for x in (wanted, starts, values, sizes))
                    inside = np.arange(REACH) < sizes[:, None]
                    other = (starts[:, None] + step * np.arange(REACH))[inside]
                    near = np.repeat(starts - step, sizes)
                    away = ends[other] - ends[near] if side else begins[near] - begins[other]
                    lists = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[text[wanted]].view(np.int64)), pa.array(number[wanted].astype(np.int32)), pa.array(np.full(len(wanted), side, np.int32)),
                         *[pa.ListArray.from_arrays(lists, pa.array(c)) for c in (values[inside].view(np.int32), away.astype(np.int32))]],
                        ["text_key", "number", "side", "windows", "bytes"])

    return docs.select(text_col).mapInArrow(run, "text_key long, number int, side int, windows array<int>, bytes array<int>")


def _farthest(group: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """By how many words each list of windows goes on as lists of its group from other documents do, over up to ``GAP`` words."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(len(parts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = group[owner].astype(np.uint64) << np.uint64(37) | k.astype(np.uint64) << np.uint64(32) | parts.view(np.uint32).astype(np.uint64)
    order = np.argsort(key)
    starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]][: len(key)])
    met = np.zeros((len(sizes), REACH), bool)
    if len(starts):
        several = np.minimum.reduceat(low[owner][order], starts) < np.maximum.reduceat(high[owner][order], starts)
        shared = order[np.repeat(several, np.diff(np.r_[starts, len(key)]))]
        met[owner[shared], k[shared]] = True
    reach = np.zeros(len(sizes), np.int32)
    for at in range(REACH):
        reach[met[:, at] & (at - 2 <= reach + GAP)] = at + 1
    return reach


def reaches(kinds: DataFrame, crowd: int = CROWD) -> DataFrame:
    """like, reach: by how many words the open ends among ``kinds`` (component, side, like, windows, open, low, high) go on as in
    another document. The ends of a component's side meet in a task as whole lists; those of more than ``crowd`` different lists meet
    word by word instead, so that none is large. A bitmap tells these; whoever it takes for one of them has the same result."""
    many = kinds.groupBy("component", "side").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    crowded = kinds.sparkSession.sparkContext.broadcast(_bitmap(many.select(F.xxhash64("component", "side").alias("key"))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _taken(crowded.value, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(hit)], [*batch.schema.names[1:], "crowded"])

    columns = ["component", "side", "like", "windows", "open", "low", "high"]
    routed = kinds.select(F.xxhash64("component", "side").alias("key"), *columns).mapInArrow(
        route, "component long, side int, like long, windows array<int>, open boolean, low long, high long, crowded boolean")
    met = F.count(F.lit(1)) + F.count_if(F.expr("low < high"))
    groups = routed.where("NOT crowded").groupBy("component", "side").agg(
        F.collect_list(F.struct("like", "open", "low", "high", "windows")).alias("m"), met.alias("n"), F.max("open").alias("open")).where("open AND n > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.columns
            group = np.repeat(np.arange(batch.num_rows), lists[0].value_lengths().to_numpy(zero_copy_only=False))
            like, open_, low, high = (c.flatten().to_numpy(zero_copy_only=False) for c in lists[:4])
            windows = lists[4].flatten()
            reach = _farthest(group, low, high, windows.value_lengths().to_numpy(zero_copy_only=False), windows.flatten().to_numpy(zero_copy_only=False))
            far = open_.astype(bool) & (reach > 0)
            yield pa.RecordBatch.from_arrays([pa.array(like[far]), pa.array(reach[far])], ["like", "reach"])

    small = groups.select("m.like", "m.open", "m.low", "m.high", "m.windows").mapInArrow(run, "like long, reach int")
    parts = routed.where("crowded").select("like", "open", "low", "high", "component", "side", F.posexplode("windows").alias("k", "part"))
    parts = parts.select("like", "open", "low", "high", "k", F.xxhash64("component", "side", "k", "part").alias("key"))
    shared = parts.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("key")
    on = lambda r, k: F.when(k - 2 <= r + GAP, k + 1).otherwise(r)
    large = parts.where("open").select("like", "k", "key").join(shared, "key", "left_semi").groupBy("like").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    return small.unionByName(large.select("like", F.aggregate("ks", F.lit(0), on).alias("reach")).where("reach > 0"))


def extensions(docs: DataFrame, marked: DataFrame, text_col: str = "text") -> DataFrame:
    """text_key, number, side, reach, away: by how many words (and bytes) the paragraph at an end of a stretch goes on as in another
    document with a paragraph of its component. Copies of a text have the same ends and surroundings, so a text is worked on once,
    with the first and last of its documents; equal surroundings are one row before they are taken apart."""
    inside = Window.partitionBy("text_key").orderBy("number")
    alone = lambda other, step: F.coalesce(other != F.col("number") + step, F.lit(True))
    sides = F.array(F.struct(F.lit(0).alias("side"), (alone(F.lag("number").over(inside), -1) & (F.col("number") > 0)).alias("open")),
                    F.struct(F.lit(1).alias("side"), alone(F.lead("number").over(inside), 1).alias("open")))
    document = F.when(F.col("id").isNull(), F.xxhash64(F.lit(0), "text_key")).otherwise(F.xxhash64(F.lit(1), "id"))
    texts = marked.groupBy("text_key", "number", "component").agg(F.min(document).alias("low"), F.max(document).alias("high"))
    columns = ["text_key", "number", "component", "low", "high"]
    sided = store(texts.select(*columns, sides.alias("sides")).select(*columns, F.inline("sides")), "sides")
    # a document whose paragraph goes on repeating may be the one that an end elsewhere goes on like
    ends = store(sided.join(sided.where("open").select("component", "side").distinct(), ["component", "side"], "left_semi"), "ends")
    words = store(ends.join(beside(docs, ends, text_col), ["text_key", "number", "side"]).withColumn("like", F.xxhash64("component", "side", "windows")), "beside")
    kinds = store(words.groupBy("component", "side", "like").agg(
        F.any_value("windows").alias("windows"), F.max("open").alias("open"), F.min("low").alias("low"), F.max("high").alias("high")), "kinds")
    reach = reaches(kinds)
    return words.where("open").join(reach, "like").select("text_key", "number", "side", "reach", F.get("bytes", F.col("reach") - 1).alias("away"))


def repeated_passages(docs: DataFrame, threshold: float = 0.8, recall: float = 0.98, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, end (bytes of UTF-8, end exclusive), words (that repeat), removed, components: the passages of every document that
    also stand in another one. Of each component the paragraphs of the first document stay (``removed`` is false there); a passage that
    is removed in parts has a row for each part of ``PART`` words or more, and shorter parts stay."""
    ship(docs.sparkSession)
    rows = 2
    found = store(collisions(banded(docs, tune_bands(threshold, recall, rows), rows, text_col)), "collisions")
    wanted = store(found.where("NOT crowded").select(F.explode(F.array("a", "b")).alias("paragraph")).unionByName(
        found.where("crowded").select(F.col("b").alias("paragraph"))).distinct(), "wanted")
    placed = store(occurrences(docs, wanted, id_col, text_col), "occurrences")
    sets = placed.groupBy("paragraph").agg(F.any_value("shingles").alias("shingles"))
    reached = connected_components(verified_links(found, store(sets, "sets"), threshold)).withColumnRenamed("node", "paragraph")
    named = placed.drop("shingles").join(reached, "paragraph", "left").withColumn("component", F.coalesce("component", "paragraph"))
    document = F.struct(F.col("id").isNull().alias("late"), "id", "text_key")
    marked = named.join(_several(named, "component"), "component").withColumn("removed", document != F.col("one")).drop("one", "paragraph")
    marked = store(marked.dropDuplicates(["id", "text_key", "number"]), "marked")
    more = extensions(docs, marked, text_col).groupBy("text_key", "number").agg(
        *[F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{c}_{side}") for side in (0, 1) for c in ("reach", "away")])
    inside = Window.partitionBy("id", "text_key").orderBy("number")
    after = F.col("first") + F.col("words")
    low = F.greatest(F.col("first") - F.coalesce("reach_0", F.lit(0)), F.coalesce(F.lag(after).over(inside), F.lit(0)))
    high = F.least(after + F.coalesce("reach_1", F.lit(0)), F.lead("first").over(inside))  # a paragraph that repeats is not another's extension
    start = F.greatest(F.col("start") - F.coalesce("away_0", F.lit(0)), F.lag("end").over(inside))
    end = F.least(F.col("end") + F.coalesce("away_1", F.lit(0)), F.lead("start").over(inside))
    wide = marked.join(more, ["text_key", "number"], "left").select("id", "text_key", "number", "component", "removed", start.alias("start"), end.alias("end"), low.alias("low"), high.alias("high"))
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    cut = wide.withColumn("upto", F.max("high").over(earlier)).withColumn("start", F.greatest("start", F.max("end").over(earlier)))
    cut = cut.withColumn("apart", F.coalesce(F.col("low") > F.col("upto") + GAP, F.lit(False)).cast("int"))
    turned = F.coalesce(F.col("removed") != F.lag("removed").over(inside), F.lit(False)).cast("int")
    new = F.greatest(F.col("high") - F.greatest("low", F.coalesce("upto", F.lit(0))), F.lit(0))
    runs = cut.withColumn("turned", F.greatest("apart", turned)).withColumn("new", new).withColumn("run", F.sum("apart").over(inside)).withColumn("part", F.sum("turned").over(inside))
    parts = runs.groupBy("id", "text_key", "run", "part", "removed").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("new").alias("words"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.array_sort(F.collect_set("component")).alias("components"))
    whole = Window.partitionBy("id", "text_key", "run")
    sized = parts.withColumn("span", F.max("high").over(whole) - F.min("low").over(whole)).withColumn("repeats", F.sum("words").over(whole))
    long = (F.col("span") >= min_words) & (F.col("repeats") >= F.lit(threshold * min_words)) & (F.col("words") >= PART)
    return sized.where(long).select("id", "start", "end", "words", "removed", "components")
