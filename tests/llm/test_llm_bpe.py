import hashlib
import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest
from conftest import MEDIUM
from llm_cases import no_docs, odd_docs  # noqa: F401
from tokenizers import Tokenizer

from threadlens.llm.bpe import ROWS_OUT, Encoder, _map_texts, digest_documents, encode_documents
from threadlens.llm.common import slices, table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return Encoder(f.read())


def same(library, encoder, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == want, repr(text)
    assert list(struct.unpack(f"<{len(want)}H", encoder.pack(text))) == want
    assert encoder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_odd_texts_as_the_library(library, encoder):
    letters = list("aaaabeiounrtsn''SΣσ \t\n\x1c\x1f\x85 é́İßŁ<|>12٣ँक中\U0001F600\u200b​́½ǅ \u00a0\u3000﻿\x00")
    rng = random.Random(5)
    for _ in range(3000):
        same(library, encoder, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))))
    for text in ("<|startoftext|>hi<|endoftext|> <|START|>", "<|endoftext|><|endoftext|>x", "ΑΣ ΑΣΣ", "a" * 3000, "the" * 2000, ""):
        same(library, encoder, text)


def test_whole_table_as_the_library(spark, library):
    got = {r[0]: tuple(r)[1:] for r in digest_documents(table(spark, MEDIUM, "documents"), PATH).collect()}
    for doc_id, text in table(spark, MEDIUM, "documents").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_odd_rows(odd_docs, no_docs, encoder):
    rows = encode_documents(odd_docs, PATH).collect()
    assert len(rows) == 10
    assert [r.tokens for r in rows if r.doc_id in (3, 4, 6)] == [[], [], []]
    assert next(r for r in rows if r.doc_id == 7).tokens == encoder.encode("É\u00a0x<|endoftext|>ΑΣ")
    assert encode_documents(no_docs, PATH).collect() == [] and digest_documents(no_docs, PATH).collect() == []


def test_memo_of_small_size_changes_nothing(library):
    with open(PATH, encoding="utf-8") as f:
        small = Encoder(f.read())
    for memo in (small.of_chunk, small.of_piece, small.fits):
        memo.limit = 3
    for text in ("the cat sat on the mat, and the cat's hat was on the mat", "unbelievable internationalisation"):
        same(library, small, text)


def test_pair_test_against_merging(encoder):
    def merged(symbols):
        ids = [encoder.id_of[s] for s in symbols]
        while len(ids) > 1:
            ranked = [(encoder.merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in encoder.merges]
            if not ranked:
                break
            k = min(ranked)[1]
            ids[k : k + 2] = [encoder.merges[ids[k], ids[k + 1]][1]]
        return ids

    rng = random.Random(9)
    inner = [i for i, s in encoder.symbols_of.items() if ord(s[-1]) < 0xE000 and all(c in encoder.id_of for c in s)]
    short = [i for i in inner if len(encoder.symbols_of[i]) <= 3]
    tokens = [i for i, s in encoder.symbols_of.items() if all(c in encoder.id_of for c in s)]
    seen = set()
    for n in range(30_000):
        left, right = rng.choice(short if n % 2 else inner), rng.choice(short if n % 3 else tokens)
        want = merged(encoder.symbols_of[left] + encoder.symbols_of[right]) == [left, right]
        assert encoder._fits((left << 24) + right) == want, (left, right)
        seen.add(want)
    for left in rng.sample(inner, 3000):  # a token beside itself
        assert encoder._fits((left << 24) + left) == (merged(encoder.symbols_of[left] * 2) == [left, left])
    assert seen == {True, False}


def test_long_runs_are_not_kept(encoder):
    encoder.encode("z" * 5000 + " " + "q" * 65)
    assert not any(len(k) > 64 for memo in (encoder.of_chunk, encoder.of_piece) for k in memo)


def test_texts_packed_together_as_the_library(library, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        encoder = Encoder(f.read())
    letters = ["<|endoftext|>", "<|START|>", "'s", "'ll", *"  eeiost'!9ABSéÉßİŁǅ \t\n\x1c\x85 ̧́ЁйΣς’—中が゙각ᆨ\U0001F600"]
    rng = random.Random(11)
    texts = [None, "", " ", "\x1f", "b" * 5000, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000))]
    texts += [f"a{chr(c)}e {chr(c)}'S{chr(c)}" for c in [*range(1, 0x530), *range(0x2000, 0x205F)]]
    texts += ["".join(map(chr, range(c, c + 64))) for c in [*range(0x3000, 0xA000, 64), *range(0xAC00, 0xD780, 64)]]
    want = [struct.pack(f"<{len(ids) + 1}H", *ids, 7) for ids in (library.encode(t or "", add_special_tokens=False).ids for t in texts)]
    for memo in (encoder.packed.limit, 3):  # a memo that is given up again and again changes nothing
        encoder.packed.limit = memo
        assert encoder.pack_texts(pa.array(texts), b"\x07\x00").to_pylist() == want
        assert encoder.pack_texts(pa.array(texts)[17:900], b"\x07\x00").to_pylist() == want[17:900]
        assert not any(len(k) > 64 for k in encoder.packed)
    encoder.packed.limit, fresh, pack = 100, [], encoder._pack_fresh
    monkeypatch.setattr(encoder, "_pack_fresh", lambda pieces: fresh.extend(pieces) or pack(pieces))
    for _ in range(2):
        encoder.pack_texts(pa.array(["Zebrafoo, ZEBRAFOO zebrafoo! 4zebrafoo4", "zebrafoo,"] * 50))
    assert fresh == ["zebrafoo"]


def test_slices_hold_every_row_once():
    for lengths in ([], [0], [30], [0, 30, 0, 4, 4, 4, 11, None, 3], [None] * 3):
        texts = pa.array([None if n is None else "x" * n for n in lengths], pa.string())
        found = list(slices(texts, 10))
        assert [k for first, n in found for k in range(first, first + n)] == list(range(len(lengths))) and all(n > 0 for _, n in found)


def test_long_texts_are_encoded_a_few_at_a_time(spark):
    """What a worker holds at once is bounded by bytes of text, not by a number of texts of any length."""
    texts = [None, "", "\u00e9" * ROWS_OUT, *["lorem ipsum " * 2_000] * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    together = _map_texts(docs, PATH, "doc_id", "text", "bytes long", lambda _, part: {"bytes": pa.array([sum(len((t or "").encode()) for t in part)] * len(part))})
    got = {r.doc_id: r.bytes for r in together.collect()}
    assert got.keys() == set(range(len(texts))) and got[2] == 2 * ROWS_OUT
    assert all(n <= ROWS_OUT for i, n in got.items() if i != 2)
