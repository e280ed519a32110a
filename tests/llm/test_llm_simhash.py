import random
from collections import defaultdict

import numpy as np
import xxhash
from llm_cases import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from threadlens.llm.common import table
from threadlens.llm.components import connected_components
from threadlens.llm.simhash import drop_near_duplicates, fingerprint_hex, link_fingerprints, majority, near_duplicate_groups, shingle_hashes, spanning_links

SMALL = "/root/testdata/sf0.001"


def groups_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_repeats(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(100, 160)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(70)] + [(5, 5), (200, 100)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    want = groups_of({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n in got} and all(n in got for p in links if p[0] != p[1] for n in p)
    assert connected_components(df.limit(0)).count() == 0


def test_majority_bit_by_bit():
    hashes = np.array([xxhash.xxh64_intdigest(str(i), 42) for i in range(7)], np.uint64)
    assert majority(hashes) == sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in hashes) * 2 > 7)
    assert majority(hashes[:0]) == 0


def test_hash_is_that_of_spark(spark):
    want = spark.range(1).select(F.xxhash64(F.lit("a é c d"))).first()[0]
    assert np.array(shingle_hashes("A é C\td", 4)).view(np.int64).tolist() == [want]


def close_fingerprints(n, seed):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.add(base)
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
    return sorted(out)


def test_links_against_all_pairs(spark):
    prints = close_fingerprints(150, 2)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    want = groups_of(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if (a ^ b & 2**64 - 1) & 2**64 - 1 and ((a ^ b) & 2**64 - 1).bit_count() <= 4])
    for blocks, tile in ((5, 100), (6, 100), (7, 100), (6, 1)):
        links = [tuple(r) for r in link_fingerprints(df, 4, blocks, tile).collect()]
        assert groups_of(signed, links) == want, (blocks, tile)
        assert all(((a ^ b) & 2**64 - 1).bit_count() <= 4 for a, b in links)


def test_spanning_links_are_few():
    dense = np.array([1 << i for i in range(60)], np.uint64)
    assert len(spanning_links(dense, 4)) == 59


def test_whole_table_against_all_pairs(spark):
    rows = near_duplicate_groups(table(spark, SMALL, "documents")).select("id", fingerprint_hex(F.col("fingerprint")).alias("f"), "component_id").collect()
    prints = {r.id: int(r.f, 16) for r in rows}
    for doc_id, text in table(spark, SMALL, "documents").select("doc_id", "text").collect():
        assert prints[doc_id] == majority(shingle_hashes(text, 4))
    ids = sorted(prints)
    want = groups_of(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert {r.id: r.component_id for r in rows} == want


def test_odd_rows(odd_docs, no_docs):
    rows = near_duplicate_groups(odd_docs).collect()
    assert len(rows) == 10
    by = defaultdict(set)
    for r in rows:
        by[r.id].add(r.component_id)
    assert by[1] == by[2] == {1} and by[3] == by[4] == by[6] == {3} and 3 in by[None]
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 5, 7]
    assert near_duplicate_groups(no_docs).count() == 0 and drop_near_duplicates(no_docs).count() == 0


def test_rounds_of_components_keep_few_files(spark, monkeypatch):
    """A round of few links is not stored in a file per shuffle partition."""
    from threadlens.llm import components

    monkeypatch.setattr(components, "_FILE", 400, raising=False)
    stored, store = [], components.store
    monkeypatch.setattr(components, "store", lambda df, name: stored.append((name, out := store(df, name))) or out)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chains = spark.range(3_000).where("id % 100 <> 99").selectExpr("id AS a", "id + 1 AS b")
        got = {r.node: r.component for r in connected_components(chains).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {n: n - n % 100 for n in range(3_000)}
    files = [len(out.inputFiles()) for name, out in stored if name == "stars"]
    assert files and max(files) <= max(spark.sparkContext.defaultParallelism, 8)
