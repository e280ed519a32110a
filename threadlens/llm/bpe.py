"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A text is encoded piece by piece. In a piece, the encoding of every prefix ends in exactly one token: among the tokens
that end there (found by an automaton over the vocabulary that follows suffix links), it is the one that begins at
place 0 or fits the last token of the prefix before it. Two tokens fit if no merge across their border would have come
before the merges that made them. Back-pointers from the end of the piece give the ids. The work is linear in the length of the
piece times the tokens that end at a place, also for pieces without any space.

The vocabulary file is that of the ``tokenizers`` library (kind BPE with word ends, no decoder): special tokens are cut
out of the raw text first, then each piece between white space is normalised (NFC, lower case by character), split and
encoded. Decoding joins the tokens of the ids with one space, as that library does for a file without decoder.

Defined cases: NULL and empty texts have no ids and decode to an empty text; repeated rows are encoded alike; an empty
table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from threadlens.llm.common import ship, slices

#: White space of the vocabulary's splitting rule (fixed values: Unicode White_Space).
_SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = re.compile(f"[{_SPACES}]+")
#: Characters that str.split() takes for white space and the rule does not.
_ODD = re.compile("[\x1c-\x1f]")
#: The last symbol of a piece is moved to this private block.
_END = 0xE000
#: A pair of ids as one number.
_PAIR = 1 << 24
#: Entries of a memo before its older half is given up; bounds the memory of a worker.
_MEMO = 400_000
#: Stands before a piece among pieces that are encoded together: a line feed, which none holds.
_BORDER = _PAIR - 1
#: Bytes of text whose pieces are looked up together, and characters of pieces that are encoded together.
SLICE, _TOGETHER = 24 << 20, 1 << 16
#: Bytes of text that are encoded and decoded before their rows go out; bounds the memory of a worker (one text at least).
ROWS_OUT = 1 << 18
#: Characters that no normalisation joins with others and that any version of Unicode classes and lower-cases alike (an
#: expression of RE2): Latin, Cyrillic, marks, Kana, Chinese, Korean; not the separators of ``_ODD``.
_PLAIN = r"\x00-\x1b\x20-\x{012f}\x{0131}-\x{024f}\x{0400}-\x{0482}\x{048a}-\x{052f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}"
#: Longest run of letters that a memo keeps, so that its bytes are bounded as well.
_KEPT = 64


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """A dictionary of bounded size that makes missing values; what was used since the last turn stays."""

    def __init__(self, make, limit: int = _MEMO):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        return self.keep(key, value)

    def keep(self, key, value):
        """Take a value in, unless its key is too long."""
        if type(key) is str and len(key) > _KEPT:
            return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def known(self, key):
        """The value of a key, None if there is none yet."""
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.keep(key, value)
        return value


class Encoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, content: str, memo: int = _MEMO):
        spec = json.loads(content)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        self.text_of: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.specials.items()}
        parts = sorted(map(re.escape, self.specials), key=len, reverse=True)
        self.special_re = re.compile("(" + "|".join(parts) + ")") if parts else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split.replace(r"\s", _SPACES)).findall
        self.symbols = _byte_symbols()

        def ended(token: str) -> str:
            return token[: -len(suffix) - 1] + chr(ord(token[-len(suffix) - 1]) + _END) if token.endswith(suffix) and token != suffix else token

        self.symbols_of = {i: ended(t) for t, i in model["vocab"].items()}
        self.id_of = {s: i for i, s in self.symbols_of.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.id_of[ended(left)], self.id_of[ended(right)]
            self.merges[a, b] = (rank, self.id_of[self.symbols_of[a] + self.symbols_of[b]])
        self.automaton = ahocorasick.Automaton()
        for symbols, i in self.id_of.items():
            if len(symbols) > 1:
                self.automaton.add_word(symbols, (len(symbols), i))
        self.automaton.make_automaton()
        self.length_of = {i: len(s) for i, s in self.symbols_of.items()}
        self.lengths = np.array([self.length_of.get(i, 0) for i in range(max(self.length_of) + 1)])
        self.code_of = np.array([ord(s) if b != 10 else 10 for b, s in enumerate(self.symbols)], np.uint32)
        self.single = np.zeros(_END + 512, np.int64)
        for c in map(ord, self.symbols):
            self.single[c], self.single[c + _END] = self.id_of[chr(c)], self.id_of[chr(c + _END)]
        self.single[10] = _BORDER
        self.odd_re = "|".join([*parts, f"[^{_PLAIN}]"])
        # What is not a run of letters, in RE2; such pieces are set apart by spaces.
        self.apart_re = "(" + split.replace(r"|[\p{L}]+", "").replace(r"\s", _SPACES) + ")"
        self.shown = {i: str(i) for i in self.text_of}
        self.made = Memo(self._make, 2 * len(self.symbols_of))  # never turned over: a vocabulary's tokens
        self.fits = Memo(self._fits, memo)
        self.of_piece = Memo(self._encode_piece, memo)
        self.of_chunk = Memo(self._encode_chunk, memo)
        self.packed = Memo(None, memo)

    def _make(self, token: int) -> tuple[int, int, int] | None:
        """Rank and parts of the merge that ends in the token when its own symbols are merged by rank; rank -1 for a
        single symbol, None if they end in other tokens."""
        ids = [self.id_of[s] for s in self.symbols_of[token]]
        made = (-1, token, token)
        while len(ids) > 1:
            ranked = [(self.merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
            if not ranked:
                return None
            rank, k = min(ranked)
            made = (rank, ids[k], ids[k + 1])
            ids[k : k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return made if ids == [token] else None

    def _fits(self, pair: int) -> bool:
        """Whether the two tokens stay apart.

        Their merges are undone along the border, the latest first: the tokens would not stay apart if two that face
        each other there have a merge that comes before the one just undone (of equal ranks the left place comes first).
        """
        left, right = divmod(pair, _PAIR)
        made, merges, limit = self.made, self.merges, len(self.merges)
        if left == _BORDER:
            return made[right] is not None
        of_left, of_right = made[left], made[right]
        if of_left is None or of_right is None:
            return False
        while True:
            merge = merges.get((left, right))
            if merge is not None and merge[0] < limit:
                return False
            if of_left[0] > of_right[0]:
                limit, left = of_left[0], of_left[2]
                of_left = made[left]
            elif of_right[0] < 0:
                return True
            else:
                limit, right = of_right[0] + 1, of_right[1]
                of_right = made[right]

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        return self._encode_symbols(piece if piece.isascii() and piece.isalnum() else "".join([self.symbols[b] for b in piece.encode("utf-8")]))

    def _encode_symbols(self, symbols: str) -> tuple[int, ...]:
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + _END)
        whole = self.id_of.get(symbols)
        if whole is not None and self.made[whole] is not None:
            return (whole,)
        # Where no longer token fits, the prefix ends in its last symbol alone.
        last, fits, done = [self.id_of[s] for s in symbols], self.fits, -1
        for end, (length, token) in self.automaton.iter(symbols):  # longest first at each end
            if end != done and (length > end or fits[last[end - length] * _PAIR + token]):
                last[end], done = token, end
        ids, at, length_of = [], len(symbols) - 1, self.length_of
        while at >= 0:
            ids.append(last[at])
            at -= length_of[last[at]]
        ids.reverse()
        return tuple(ids)

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of a run without white space."""
        if chunk.isascii():
            plain = chunk.lower()
            if plain.isalpha():
                return self._encode_symbols(plain) if plain == chunk else self.of_chunk[plain]
            word, mark = plain[:-1], plain[-1]
            if word.isalpha() and not mark.isalpha():  # the commonest chunk beside plain letters
                return self.of_chunk[word] + self.of_piece[mark]
        else:
            plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        # A piece of plain letters is a chunk too, and found there.
        return tuple([i for piece in self.pieces(plain) for i in (self.of_chunk if piece.isascii() and piece.isalpha() else self.of_piece)[piece]])

    def _pack_fresh(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of pieces, which one run of the automaton encodes: no token goes across the end of a piece."""
        raw = np.frombuffer(("\n" + "\n".join(pieces) + "\n").encode(), np.uint8)
        borders = np.flatnonzero(raw == 10)
        codes = self.code_of[raw]
        codes[borders[1:] - 1] += _END
        last, fits, done = self.single[codes].tolist(), self.fits, -1
        for end, (length, token) in self.automaton.iter(codes.tobytes().decode("utf-32-le")):  # longest first at each end
            if end != done and fits[last[end - length] * _PAIR + token]:
                last[end], done = token, end
        tokens = np.array(last)
        used, at = np.zeros(len(tokens), bool), borders[1:] - 1
        while len(at):  # every piece from its end, one token a turn
            used[at] = True
            at = at - self.lengths[tokens[at]]
            at = at[raw[at] != 10]
        ids = tokens[used].astype("<u2").tobytes()
        upto = (2 * np.cumsum(used)[borders]).tolist()
        return [ids[i:j] for i, j in zip(upto, upto[1:])]

    def _pack_pieces(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of different pieces (none for an empty one)."""
        out, known = list(map(self.packed.get, pieces)), self.packed.known
        fresh, size = [], 0

        def close() -> None:
            for k, value in zip(fresh, self._pack_fresh([pieces[k] for k in fresh])):
                out[k] = self.packed.keep(pieces[k], value)
            fresh.clear()

        for k in [k for k, value in enumerate(out) if value is None]:
            out[k] = known(pieces[k]) if pieces[k] else b""
            if out[k] is None:
                fresh.append(k)
                size += len(pieces[k])
                if size > _TOGETHER:
                    close()
                    size = 0
        if fresh:
            close()
        return out

    def _values(self, text: str | None) -> Iterator:
        """The ids of the runs of a text between white space and of special tokens."""
        if not text:
            return
        parts = [text] if self.special_re is None or not self.special_re.search(text) else self.special_re.split(text)
        for part in parts:
            if part in self.specials:
                yield [(self.specials[part],)]
            else:
                yield map(self.of_chunk.__getitem__, filter(None, _SPLIT.split(part)) if _ODD.search(part) else part.split())

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text."""
        return list(chain.from_iterable(chain.from_iterable(self._values(text))))

    def pack(self, text: str | None) -> bytes:
        """The ids of a text, 16 bits each, little-endian (for vocabularies of up to 65,536 tokens)."""
        return self.pack_texts(pa.array([text], pa.string()))[0].as_py()

    def pack_texts(self, texts: pa.StringArray, end: bytes = b"") -> pa.BinaryArray:
        """The ids of every text packed as above, each followed by ``end``. Different pieces are looked up once; texts
        with special tokens or other characters than ``_PLAIN`` are encoded by themselves."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd_re).to_numpy(zero_copy_only=False)
        whole = {k: np.array(self.encode(texts[k].as_py()), "<u2").tobytes() for k in np.flatnonzero(odd).tolist()}
        if whole:
            texts = pc.if_else(pa.array(odd), "", texts)
        lists = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), self.apart_re, r" \1 "))
        words = lists.flatten().dictionary_encode()
        values = [*self._pack_pieces(words.dictionary.to_pylist()), end, *[value + end for value in whole.values()]]
        sizes = lists.value_lengths().to_numpy()
        stops = np.cumsum(sizes + 1) - 1  # a place more for each text's end
        picks = np.full(len(words) + len(texts), len(words.dictionary), np.int32)
        inside = np.ones(len(picks), bool)
        inside[stops] = False
        picks[inside] = words.indices.to_numpy()
        picks[stops[list(whole)]] += np.arange(1, len(whole) + 1, dtype=np.int32)
        joined = pa.array(values, pa.binary()).take(pa.array(picks))
        _, offsets, data = joined.buffers()
        bounds = np.frombuffer(offsets, np.int32)[: len(joined) + 1][np.r_[0, stops + 1]]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.tobytes()), data])

    def decode(self, ids) -> str:
        """The text of ids."""
        return " ".join(map(self.text_of.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by a space and of the decoded text."""
        shown = " ".join(map(self.shown.__getitem__, ids))
        return len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


_LOADED: dict[tuple[int, int], Encoder] = {}


def _encoder(content, memo: int = _MEMO) -> Encoder:
    """One encoder per worker process and vocabulary, so that its memos outlive a task."""
    text = content.value
    key = hash(text), memo
    if key not in _LOADED:
        _LOADED[key] = Encoder(text, memo)
        gc.freeze()  # the vocabulary stays: the collector need not walk it again
    return _LOADED[key]


def _map_texts(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, row, memo: int = _MEMO) -> DataFrame:
    ship(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # of fixed size: a vocabulary
    picked = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content, memo)
        for batch in batches:
            for first, n in slices(batch.column(1), ROWS_OUT):
                part = batch.slice(first, n)
                columns = row(encoder, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns.values()], [part.schema.names[0], *columns])
                del part, columns
            del batch  # not held while the next one is read

    kind = picked.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", memo: int = _MEMO) -> DataFrame:
    """Id, ``tokens`` (array of int) and ``decoded`` (the text of these ids); ``memo`` bounds the memory of a worker."""

    def row(encoder: Encoder, texts):
        ids = [encoder.encode(t) for t in texts]
        return {"tokens": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(map(encoder.decode, ids), pa.string())}

    return _map_texts(docs, path, id_col, text_col, "tokens array<int>, decoded string", row, memo)


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_tokens, ids_sha256 and decoded_sha256: encodes and decodes as above, and keeps only digests.

    For checks over large tables, where the ids themselves would be several times the input.
    """

    def row(encoder: Encoder, texts):
        n, ids, back = zip(*[encoder.digests(encoder.encode(t)) for t in texts]) if texts else ((), (), ())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(back, pa.string())}

    return _map_texts(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)
