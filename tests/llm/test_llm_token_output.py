import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from conftest import MEDIUM
from llm_cases import no_docs, odd_docs  # noqa: F401

from threadlens.llm.bpe import Encoder
from threadlens.llm.common import table
from threadlens.llm.token_output import permute, read_sequences, write_shards

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 4097])
def test_permutation(n):
    there = permute(np.arange(n), n, "k")
    assert sorted(there) == list(range(n)) and (permute(there, n, "k", True) == np.arange(n)).all()
    assert n < 64 or (there != permute(np.arange(n), n, "other")).any()


def test_round_trip_through_the_shards(spark, tmp_path):
    docs, path = table(spark, MEDIUM, "documents"), str(tmp_path / "shards")
    rows = {r.slot: r for r in write_shards(docs, PATH, path, seq_len=512, per_shard=300).collect()}
    with open(f"{path}/manifest.json") as f:
        manifest = json.load(f)
    n = manifest["sequences"]
    assert sorted(rows) == list(range(n))
    read = {r.slot: r.tokens for r in read_sequences(spark, path).collect()}
    for slot, tokens in read.items():
        data = np.array(tokens, "<u2").tobytes()
        assert rows[slot].sha256 == hashlib.sha256(data).hexdigest()
        with open(f"{path}/shard-{rows[slot].shard:06d}.bin", "rb") as f:
            f.seek(rows[slot].byte_offset)
            assert f.read(1024) == data
    back = permute(np.arange(n), n, "order")
    stream = [t for number in range(n) for t in read[int(back[number])]]
    with open(PATH, encoding="utf-8") as f:
        encoder = Encoder(f.read())
    want = [t for r in docs.collect() for t in [*encoder.encode(r.text), 49407]]
    assert stream[: manifest["tokens"]] == want and set(stream[manifest["tokens"] :]) <= {49407}
    part = {r.slot: r.tokens for r in read_sequences(spark, path, 250, 700).collect()}
    assert part == {s: read[s] for s in range(250, 700)}


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    rows = write_shards(odd_docs, PATH, str(tmp_path / "odd"), seq_len=64, per_shard=10).collect()
    assert sum(r.n_tokens for r in rows) == sum(1 + len(t) for t in _ids(odd_docs))
    assert write_shards(no_docs, PATH, str(tmp_path / "none")).collect() == [] and read_sequences(spark, str(tmp_path / "none")).collect() == []


def _ids(docs):
    with open(PATH, encoding="utf-8") as f:
        encoder = Encoder(f.read())
    return [encoder.encode(r.text) for r in docs.collect()]


def test_a_folder_whose_shards_failed_has_no_manifest(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * 50) for i in range(40)], "doc_id long, text string")
    blocked = tmp_path / "blocked"
    (blocked / "shard-000001.bin").mkdir(parents=True)
    (blocked / "shard-000001.bin" / "x").write_text("in the way")
    with pytest.raises(Exception):
        write_shards(docs, PATH, str(blocked), seq_len=64, per_shard=20)
    assert not (blocked / "manifest.json").exists()
    rows = write_shards(docs, PATH, str(tmp_path / "whole"), seq_len=64, per_shard=20)
    with open(tmp_path / "whole" / "manifest.json") as f:
        n = json.load(f)["sequences"]
    rows.limit(3).collect()
    assert len(list((tmp_path / "whole").glob("shard-*.bin"))) == -(-n // 20) and rows.count() == n
