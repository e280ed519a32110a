import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from conftest import MEDIUM
from llm_cases import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from threadlens.llm.common import table
from threadlens.llm.substring_dedup import FEW, GAP, REACH, all_paragraphs, collisions, paragraphs, reaches, repeated_passages, sorted_sets, spanning_links, text_bytes, tune_bands, verified_links, windows, word_hashes


def test_bands_reach_the_recall():
    b = tune_bands(0.8, 0.98, 2)
    assert 1 - (1 - 0.8**2) ** b >= 0.98 > 1 - (1 - 0.8**2) ** (b - 1)


def test_a_passage_is_cut_alike_wherever_it_stands():
    rng = random.Random(1)
    words = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    passage = words(60)
    a, b = (paragraphs(f"{words(33)} {passage} {words(21)}".encode()) for _ in range(2))
    assert len(set(a[1].tolist()) & set(b[1].tolist())) >= 2
    for first, whole, shingles, starts in (a, b):
        sizes = np.diff(first)
        assert first[0] == 0 and first[-1] == 114 and len(whole) == len(sizes) == len(starts) - 1
        assert (np.diff(starts) == np.maximum(sizes - 4, 0)).all() and len(shingles) == starts[-1]


def test_planted_passages_are_found_and_others_are_not(spark):
    rng = random.Random(2)
    words = lambda n: [str(rng.randrange(10**6)) for _ in range(n)]
    passages, rows, want = [words(rng.randint(51, 120)) for _ in range(30)], [], set()
    for i in range(400):
        body = words(rng.randint(20, 300))
        if i % 4 == 0:
            near = [w if rng.random() > 0.01 else "changed" for w in passages[i // 4 % 30]]
            at = rng.randrange(len(body))
            body[at:at] = near
            want.add(i)
        if i % 3 == 0:
            body += "a line that many texts share".split()
        rows.append((i, " ".join(body)))
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.id for r in found} & want) > 0.95 * len(want) and {r.id for r in found} <= want
    for r in found:
        assert len(rows[r.id][1][r.start : r.end].split()) >= r.words >= 18


def test_every_shared_run_of_51_words(spark):
    docs = table(spark, MEDIUM, "documents")
    runs = defaultdict(set)
    for doc_id, text in docs.select("doc_id", "text").collect():
        w = text.lower().split()
        for i in range(len(w) - 50):
            runs[" ".join(w[i : i + 51])].add(doc_id)
    want = set().union(*(v for v in runs.values() if len(v) > 1))
    assert len({r.id for r in repeated_passages(docs).collect()} & want) >= 0.97 * len(want) > 0


def test_crowded_keys_lose_no_link(spark):
    rng = random.Random(3)
    sets = {i: sorted(rng.sample(range(12), 10)) for i in range(4 * FEW)}
    near = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.8
    keyed = spark.createDataFrame([(7, i, 1) for i in sets] + [(8, 1, 1), (8, 2, 2), (9, 3, 1), (9, 3, 1), (10, 4, 1)], "key long, paragraph long, times int")
    found = collisions(keyed)
    got = {tuple(r) for r in found.collect()}
    assert {(a, b) for a, b, crowd in got if not crowd} == {(1, 2), (2, 2), (3, 3)} and {b for _, b, crowd in got if crowd} == set(sets)
    table_ = spark.createDataFrame(list(sets.items()), "paragraph long, shingles array<long>")
    for tile in (1000, 20):
        links = [tuple(r) for r in verified_links(found, table_, 0.8, tile).collect()]
        assert all(near(a, b) for a, b in links)
        assert _groups(sets, links) == _groups(sets, [(a, b) for a in sets for b in sets if a < b and near(a, b)])
    assert len(spanning_links([1, 2, 3], [np.arange(9)] * 3, 0.8)) == 2


def _groups(nodes, links):
    of = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    return of


def test_odd_rows(spark, odd_docs, no_docs):
    rows = repeated_passages(odd_docs).collect()
    assert rows == [] or {r.id for r in rows} <= {1, 2}
    long = odd_docs.where("doc_id = 5").unionByName(odd_docs.where("doc_id = 5").withColumn("doc_id", F.lit(50).cast("long"))).unionByName(odd_docs.where("doc_id = 5"))
    assert [(r.id, r.removed, r.words) for r in sorted(repeated_passages(long).collect())] == [(5, False, 60_000), (50, True, 60_000)]
    assert repeated_passages(no_docs).collect() == []


def test_shared_passages_are_covered_word_by_word(spark):
    rng = random.Random(5)
    words = lambda n: [str(rng.randrange(10**6)) for _ in range(n)]
    rows, spans = [], {}
    for i in range(160):
        size = (51, 60, 80, 120)[i % 4]
        line = words((4, 7)[i // 4 % 2])
        passage = words(size) if i < 80 else (line * size)[:size]
        for copy in (0, 1):
            before = words(rng.randint(0, 60))
            rows.append((2 * i + copy, " ".join(before + passage + words(rng.randint(0, 60)))))
            spans[2 * i + copy] = (len(before), size)
    got = defaultdict(set)
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = rows[r.id][1]
        first = len(text[: r.start].split())
        got[r.id] |= set(range(first, first + len(text[r.start : r.end].split())))
        assert r.removed == (r.id % 2 == 1) and r.words >= 40
    want = {i: set(range(a, a + n)) for i, (a, n) in spans.items()}
    assert sum(len(got[i] & w) for i, w in want.items()) >= 0.99 * sum(map(len, want.values()))
    assert sum(len(got[i] - w) for i, w in want.items()) <= 0.001 * sum(map(len, want.values()))


def test_short_repeats_are_left_alone(spark):
    rng = random.Random(9)
    words = lambda n: [str(rng.randrange(10**6)) for _ in range(n)]
    line = words(40)
    rows = [(i, " ".join(words(50) + line + words(50))) for i in range(20)]
    assert repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


def test_surroundings_meet_alike_as_whole_lists_and_word_by_word(spark):
    rng, rows = random.Random(9), []
    for component in range(12):
        for k in range(rng.choice([1, 3, 40])):
            windows = [rng.randrange(3) if rng.random() < 0.9 else rng.randrange(-(2**31), 2**31) for _ in range(rng.randrange(REACH + 1))]
            low = rng.randrange(4)
            rows.append((component, rng.randrange(2), len(rows), windows, rng.random() < 0.6, low, low + rng.choice([0, 0, 0, 1])))
    want = {}
    for component, side, like, windows, open_, low, high in rows:
        reach = 0
        for k, part in enumerate(windows):
            seen = {d for c, s, _, w, _, a, b in rows if (c, s) == (component, side) and len(w) > k and w[k] == part for d in (a, b)}
            if len(seen) > 1 and k - 2 <= reach + GAP:
                reach = k + 1
        if open_ and reach:
            want[like] = reach
    ends = spark.createDataFrame(rows, "component long, side int, like long, windows array<int>, open boolean, low long, high long")
    for crowd in (1, 8, 1000):
        assert {r.like: r.reach for r in reaches(ends, crowd).collect()} == want
    assert reaches(ends.limit(0)).count() == 0


def test_copies_of_a_text_are_worked_on_once(spark, monkeypatch):
    import threadlens.llm.substring_dedup as m

    rng = random.Random(5)
    words = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    passage = words(80)
    texts = [f"{words(40)} {passage} {words(40)}" for _ in range(2)]
    sizes, kept = {}, m.store
    monkeypatch.setattr(m, "store", lambda df, name: sizes.setdefault(name, []).append((t := kept(df, name)).count()) or t)
    found = []
    for copies in (2, 40):
        docs = spark.createDataFrame([(i, texts[i % 2]) for i in range(2 * copies)], "doc_id long, text string").repartition(8)
        found.append({(r.id % 2, r.start, r.end, r.words) for r in repeated_passages(docs).collect()})
    assert found[0] and found[0] == found[1]
    assert sizes["sides"][0] == sizes["sides"][1] and sizes["ends"][0] == sizes["ends"][1]
    assert sizes["beside"][1] <= 8 * sizes["ends"][1]  # once a task, not once a copy and task


def _odd_texts():
    rng = random.Random(13)
    texts = ["", " ", "x", "\n", "a b c d e f", "É\x1cé " + "Lo" * 40]
    for _ in range(300):
        line = " ".join(str(rng.randrange(10**5)) for _ in range(rng.randint(1, 7)))
        words = [rng.choice(["a", "B\u00e9", " y", "zz\x1cq", "Lo" * rng.randint(1, 40), str(rng.randrange(10**5))]) for _ in range(rng.randint(0, 90))]
        texts.append(rng.choice([" ", "  ", "\n", "\t\x0b"]).join([*words, *[line] * rng.randint(0, 6)]) + rng.choice(["", " ", "\n\n"]))
    return texts


def test_words_of_texts_together_have_the_hashes_of_each():
    texts = _odd_texts()
    h, upto, begins, ends = word_hashes(*text_bytes(pa.array(["skip me", *texts])[1:]))
    data, place = "".join(texts).encode(), 0
    for text, low, high in zip(texts, upto, upto[1:]):
        words = text.encode().split()
        assert h[low:high].tolist() == [xxhash.xxh64_intdigest(w.lower()) for w in words]
        assert [data[a:b] for a, b in zip(begins[low:high], ends[low:high])] == words
        assert all(place <= a < b <= place + len(text.encode()) for a, b in zip(begins[low:high], ends[low:high]))
        place += len(text.encode())


def test_texts_together_are_cut_as_each():
    texts = _odd_texts()
    bounds, whole, shingles, starts, upto, *_ = all_paragraphs(*text_bytes(pa.array(texts)))
    sizes = np.diff(starts)
    sets, at = sorted_sets(shingles, starts[:-1][sizes > 0], sizes[sizes > 0]).to_pylist(), 0
    for k, text in enumerate(texts):
        first, own_whole, own, own_starts = paragraphs(text.encode())
        n = len(first) - 1
        assert (bounds[at : at + n] - upto[k]).tolist() == first[:-1].tolist() and upto[k + 1] - upto[k] == first[-1]
        assert whole[at : at + n].tolist() == own_whole.tolist()
        assert shingles[starts[at] : starts[at + n]].tolist() == own.tolist()
        for p in range(n):
            if own_starts[p + 1] > own_starts[p]:
                assert sets.pop(0) == np.unique(own[own_starts[p] : own_starts[p + 1]]).view(np.int64).tolist()
        at += n
    assert at == len(whole) and not sets


def test_words_beside_a_place_end_with_their_text():
    h, upto, *_ = word_hashes(*text_bytes(pa.array(["a b c d e f g", "h i j", "k"])))
    alone, _, *_ = word_hashes(*text_bytes(pa.array(["h i j"])))
    for step, starts in ((1, [7, 8, 10]), (-1, [6, 8, 9])):
        many, sizes = windows(h, np.array(starts), step, np.full(3, 7), np.full(3, 10))
        one, own = windows(alone, np.array(starts) - 7, step, np.zeros(3, int), np.full(3, 3))
        assert sizes.tolist() == own.tolist() == ([3, 2, 0] if step == 1 else [0, 2, 3])
        assert all((many[k, :n] == one[k, :n]).all() for k, n in enumerate(own))


def test_spanning_links_against_all_pairs():
    rng = random.Random(17)
    for n, kinds in ((1, 1), (30, 30), (120, 3), (120, 40)):
        sets, kind = [], [[rng.randrange(50) if rng.random() < 0.1 else rng.getrandbits(62) for _ in range(rng.randint(1, 15))] for _ in range(kinds)]
        for k in range(n):
            s = list(kind[k % kinds])
            s[rng.randrange(len(s))] = rng.getrandbits(62)
            sets.append(np.unique(np.array(s, np.int64)))
        near = lambda a, b: len(x := np.intersect1d(a, b)) >= 0.8 * (len(a) + len(b) - len(x)) - 1e-9
        group = list(range(n))
        for a in range(n):
            for b in range(a):
                if near(sets[a], sets[b]) and group[a] != group[b]:
                    group = [group[b] if g == group[a] else g for g in group]
        links = spanning_links(list(range(100, 100 + n)), sets, 0.8)
        assert len(links) == n - len(set(group)) and all(near(sets[a - 100], sets[b - 100]) for a, b in links)
