"""Token ids as binary shards in training order.

Texts are encoded, each followed by the end-of-text id, and laid end to end into one stream, which is cut into
sequences of ``seq_len`` ids (the last one is filled up with the end-of-text id). A keyed Feistel network over the
smallest power of two that holds all sequences, walked along its cycle until it falls among them, gives every sequence
a slot: a permutation that needs no table. Slots are laid into shards of ``per_shard`` sequences; each shard is one
range of slots, is written by one task in the order of slots, and has records of fixed size, so the byte range of any
slot is known and a reader can go on anywhere.

The place of a text in the stream is that in its piece of the scan after the lengths of the pieces before. The encoded
pieces are stored, so tasks that are run again see the same stream. A shard is written under a temporary name and then
renamed; a task that is run again writes the same bytes.

Defined cases: NULL and empty texts add the end-of-text id alone; repeated rows are written as often as they come; an
empty table gives no sequence; long texts run over as many sequences as they need; only id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.llm.bpe import SLICE, _encoder
from threadlens.llm.common import ship, slices
from threadlens.session import scratch_path
from threadlens.sources.sinks import store

END = "<|endoftext|>"
#: Pieces of the scan (12 bytes each) up to which their first places are broadcast.
MAX_BROADCAST = 500_000


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixing function (multiply and shift)."""
    x = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)  # fixed values: odd multipliers
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _network(x: np.ndarray, bits: int, keys: list[int], inverse: bool) -> np.ndarray:
    """The Feistel network over ``bits`` bits; the halves may differ by one bit and change roles every round."""
    low_bits = bits // 2
    high_bits = bits - low_bits
    low, high = x & np.uint64((1 << low_bits) - 1), x >> np.uint64(low_bits)
    for n in range(len(keys)) if not inverse else reversed(range(len(keys))):
        if n % 2:
            low = low ^ (_mix(high, keys[n]) & np.uint64((1 << low_bits) - 1))
        else:
            high = high ^ (_mix(low, keys[n]) & np.uint64((1 << high_bits) - 1))
    return (high << np.uint64(low_bits)) | low


def permute(numbers: np.ndarray, n: int, key: str, inverse: bool = False, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..n-1 (or back): walks on through the network while the value is n or more."""
    bits = max(2, (n - 1).bit_length())
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(rounds)]
    out = _network(numbers.astype(np.uint64), bits, keys, inverse)
    while (far := out >= n).any():
        out[far] = _network(out[far], bits, keys, inverse)
    return out.astype(np.int64)


def token_stream(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """piece, start, size, id, tokens (16 bits each, little-endian): every text with its place in its piece of the scan."""
    ship(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # of fixed size: a vocabulary
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, piece, at = _encoder(content), TaskContext.get().partitionId(), 0
        end = struct.pack("<H", encoder.specials[END])
        for batch in batches:
            for first, n in slices(batch.column(1), SLICE):
                part = batch.slice(first, n)
                ids = encoder.pack_texts(part.column(1), end)
                sizes = pc.binary_length(ids).to_numpy().astype(np.int64) // 2
                ends = at + np.cumsum(sizes)
                starts = ends - sizes
                at = int(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([piece] * len(ids), pa.int32()), pa.array(starts), pa.array(sizes), part.column(0), ids],
                    ["piece", "start", "size", "id", "tokens"])

    kind = picked.schema["id"].dataType.simpleString()
    path = scratch_path(docs.sparkSession, "stream")
    encoded = picked.mapInArrow(run, f"piece int, start long, size long, id {kind}, tokens binary")
    encoded.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(encoded.schema).parquet(path)


def write_shards(
    docs: DataFrame,
    tokenizer_path: str,
    path: str | None = None,
    key: str = "order",
    seq_len: int = 4096,
    per_shard: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the shards and return a row for every sequence: slot, shard, byte_offset, n_tokens, sha256, ids.

    ``path`` is a folder that driver and executors share (default: one in the shared scratch folder). One exchange
    takes every part of a sequence to the task of its shard. The shards are written when this function is called; the
    driver sees the total and writes the manifest after the last shard, so a folder without one is not complete.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    stream = token_stream(docs, tokenizer_path, id_col, text_col)
    lengths = stream.groupBy("piece").agg(F.max(F.col("start") + F.col("size")).alias("n"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per piece of the scan
    firsts = lengths.select("piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    total, n_pieces = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if n_pieces <= MAX_BROADCAST:  # else both sides are exchanged
        firsts = F.broadcast(firsts)
    n = -(-total // seq_len)
    fs, folder = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    fs.create_dir(folder)
    kind = stream.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, places, ids, parts = [], [], [], []
            for id_, start, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                at, end = 0, len(tokens) // 2
                while at < end:
                    number, place = divmod(start + at, seq_len)
                    step = min(end - at, seq_len - place)
                    numbers.append(number), places.append(place), ids.append(id_), parts.append(tokens[2 * at : 2 * (at + step)])
                    at += step
            slots = permute(np.array(numbers, np.int64), n, key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots // per_shard, pa.int32()), pa.array(slots), pa.array(places, pa.int32()), pa.array(ids, batch.schema.field(0).type), pa.array([pa.compress(p, "zstd", asbytes=True) for p in parts], pa.binary()), pa.array([len(p) for p in parts], pa.int32())],
                ["shard", "slot", "place", "id", "packed", "size"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        now, out, temporary = None, None, None
        record, kept = None, []

        def close() -> None:
            if out:
                out.close()
                files.move(temporary, f"{folder}/shard-{now:06d}.bin")

        def finish() -> pa.RecordBatch | None:
            rows = [(slot, slot // per_shard, slot % per_shard * seq_len * 2, size // 2, sha, ids) for slot, size, sha, ids in kept]
            kept.clear()
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(id_type)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["slot", "shard", "byte_offset", "n_tokens", "sha256", "ids"])

        def emit() -> None:
            slot, ids, parts = record
            data = b"".join(parts)
            whole = data + fill * (seq_len - len(data) // 2)
            out.write(whole)
            kept.append((slot, len(data), hashlib.sha256(whole).hexdigest(), ids))

        fill, id_type = None, None
        for batch in batches:
            id_type = batch.schema.field(3).type
            for shard, slot, _, id_, packed, size in zip(*(c.to_pylist() for c in batch.columns)):
                part = pa.decompress(packed, size, "zstd", asbytes=True)
                if record and record[0] != slot:
                    emit()
                    record = None
                if shard != now:
                    close()
                    now, temporary = shard, f"{folder}/_shard-{shard:06d}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(temporary)
                if record is None:
                    record = (slot, [], [])
                    fill = fill or np.array([end_id], "<u2").tobytes()
                record[1].append(id_)
                record[2].append(part)
            if kept:
                yield finish()
        if record:
            emit()
            close()
            yield finish()

    with open(tokenizer_path, encoding="utf-8") as f:
        end_id = next(t["id"] for t in json.load(f)["added_tokens"] if t["content"] == END)
    shards = max(1, -(-n // per_shard))
    pieces = stream.join(firsts, "piece").select("id", (F.col("start") + F.col("first")).alias("start"), "tokens").mapInArrow(
        cut, f"shard int, slot long, place int, id {kind}, packed binary, size int")
    rows = store(pieces.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot", "place").mapInArrow(
        write, f"slot long, shard int, byte_offset long, n_tokens int, sha256 string, ids array<{kind}>"), "sequences")
    # All shards are there: only now does the folder say so.
    with fs.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps({"sequences": n, "seq_len": seq_len, "per_shard": per_shard, "key": key, "tokens": total}).encode())
    return rows


def read_sequences(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """slot and tokens (array of int) of the slots from ``first`` to before ``last``; each shard is read from its byte on."""
    ship(spark)
    fs, folder = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_input_stream(f"{folder}/manifest.json") as f:
        m = json.loads(f.read())
    stop = m["sequences"] if last is None else min(last, m["sequences"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                lo, hi = max(first, shard * m["per_shard"]), min(stop, (shard + 1) * m["per_shard"])
                with files.open_input_file(f"{folder}/shard-{shard:06d}.bin") as f:
                    f.seek((lo - shard * m["per_shard"]) * m["seq_len"] * 2)
                    for at in range(lo, hi, 256):
                        count = min(256, hi - at)
                        rows = np.frombuffer(f.read(count * m["seq_len"] * 2), "<u2").reshape(count, -1).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + count), pa.int64()), pa.array(list(rows), pa.list_(pa.int32()))], ["slot", "tokens"])

    begin, end = first // m["per_shard"], -(-stop // m["per_shard"]) if stop > first else first // m["per_shard"]
    return spark.range(begin, end, 1, max(1, end - begin)).mapInArrow(run, "slot long, tokens array<int>")
