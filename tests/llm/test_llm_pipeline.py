from collections import Counter

import public_tokenizers
from conftest import MEDIUM
from llm_cases import no_docs, odd_docs  # noqa: F401
from tokenizers import Tokenizer

import corpus_pipeline
from threadlens.llm.common import table
from threadlens.llm.secrets import find_secrets
from threadlens.llm.simhash import near_duplicate_groups


def test_each_stage_works_on_what_the_one_before_has_kept(spark):
    docs, seen = table(spark, MEDIUM, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.store(stage(spark, docs, MEDIUM), name)
        seen[name] = (docs, after)
        docs = after
    before, kept = seen["toxicity"]
    gone = {r.doc_id for r in before.join(kept, "doc_id", "left_anti").collect()}
    marked = {r.doc_id: r.toxic for r in table(spark, MEDIUM, "labels").collect()}
    assert gone and sum(marked.get(i) == 0 for i in gone) <= 0.05 * len(gone)
    before, kept = seen["near_duplicates"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in near_duplicate_groups(before).collect()})
    before, masked = seen["secrets"]
    assert before.count() == masked.count() and all(not r.spans for r in find_secrets(masked).collect())
    before, mixed = seen["mixing"]
    counts = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert max(counts.values()) == 2 and 0.4 * before.count() < len(counts) <= before.count()
    for name in ("toxicity", "near_duplicates", "secrets", "mixing"):
        assert seen[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    last = seen["encoding"][1].collect()
    assert Counter(r.doc_id for r in last) == counts
    for r in last[::20]:
        assert r.tokens == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.decoded == library.decode(r.tokens, skip_special_tokens=False)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            after = corpus_pipeline.store(stage(spark, docs, MEDIUM), name)
            if name != "encoding":
                assert after.columns == docs.columns
            docs = after
