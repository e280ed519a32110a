"""The operators of this folder as named queries over the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.bpe import digest_documents
from threadlens.llm.common import table
from threadlens.llm.fingerprints import edit_study
from threadlens.llm.mixing import mixing_plan
from threadlens.llm.neighbours import nearest_neighbours
from threadlens.llm.quality_rules import judge_quality
from threadlens.llm.secrets import find_secrets, joined_spans
from threadlens.llm.simhash import fingerprint_hex, near_duplicate_groups
from threadlens.llm.spelling import counted_words, spelling_groups
from threadlens.llm.substring_dedup import repeated_passages
from threadlens.llm.token_output import write_shards
from threadlens.llm.toxicity import fit_toxicity, held_out, score_toxicity
from threadlens.llm.url_filter import filter_urls
from threadlens.llm.whitening import whiten

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Rules of the URL query (fixed values): host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(key: str, sql: str | None = None):
    """Register the decorated function, with the same rows in DuckDB's SQL."""

    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and their decoding, as digests."""
    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_url_filter", """
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id,
    translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
    FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.v, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (page_id)""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the longest fitting rule."""
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op10_mixing", r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM sized GROUP BY source),
weighed AS (SELECT source, s, 2.0::DOUBLE * s AS cap, CASE place WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM totals),
levels AS (SELECT *, row_number() OVER (ORDER BY cap / w, source) AS rn, (1.5::DOUBLE * (SELECT sum(s) FROM totals)
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
mark AS (SELECT arg_min(level, rn) FILTER (level * w < cap) AS level FROM levels),
rates AS (SELECT source, s, CASE WHEN mark.level IS NULL THEN cap ELSE least(cap, w * mark.level) END AS target FROM weighed, mark),
rated AS (SELECT source, s, target, CASE WHEN s = 0 THEN 0 ELSE target / s END AS rate FROM rates)
SELECT d.doc_id, d.size, r.s AS source_size, r.target,
    (d.size * (floor(r.rate) + CASE WHEN d.draw < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source""")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness."""
    study = edit_study(table(spark, sf_dir, "documents"))
    return study.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                        "edited_fingerprint", "near_edited", "near_next")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    return score_toxicity(docs, model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


_FENCES = """
marked AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN n_words = 0 THEN 0 ELSE word_chars * 100 // n_words END AS word_length,
    CASE WHEN word_chars = 0 THEN 0 ELSE n_symbols * 10000 // word_chars END AS symbol_share,
    CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines * 10000 // n_lines END AS dup_line_share,
    CASE WHEN n_words = 0 THEN 0 ELSE n_repeat_words * 10000 // n_words END AS repeat_share FROM counted),
vals AS (SELECT lang, source, m, v FROM (SELECT lang, source, word_length, symbol_share, dup_line_share, repeat_share FROM marked WHERE NOT base_failed)
    UNPIVOT (v FOR m IN (word_length, symbol_share, dup_line_share, repeat_share))),
floors AS (SELECT lang, source, m, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS v FROM vals),
own AS (SELECT lang, source, m, count(*) AS n, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM floors GROUP BY ALL),
by_lang AS (SELECT lang, m, count(*) AS n, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM floors GROUP BY ALL),
by_all AS (SELECT m, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM floors GROUP BY ALL),
picked AS (SELECT o.lang, o.source, o.m,
    CASE WHEN o.n >= 200 THEN o.q1 WHEN l.n >= 200 THEN l.q1 ELSE a.q1 END AS q1, CASE WHEN o.n >= 200 THEN o.q3 WHEN l.n >= 200 THEN l.q3 ELSE a.q3 END AS q3
    FROM own o JOIN by_lang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.m = o.m JOIN by_all a ON a.m = o.m),
fences AS (SELECT lang, source,
    max(q1 - greatest(150, 3 * (q3 - q1))) FILTER (m = 'word_length') AS wl, max(q3 + greatest(500, 3 * (q3 - q1))) FILTER (m = 'word_length') AS wh,
    max(q3 + greatest(1000, 3 * (q3 - q1))) FILTER (m = 'symbol_share') AS sh, max(q3 + greatest(3000, 3 * (q3 - q1))) FILTER (m = 'dup_line_share') AS dh,
    max(q3 + greatest(2000, 3 * (q3 - q1))) FILTER (m = 'repeat_share') AS rh FROM picked GROUP BY ALL)
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(word_length >= wl, true) AND coalesce(word_length <= wh, true) AND coalesce(symbol_share <= sh, true)
    AND coalesce(dup_line_share <= dh, true) AND coalesce(repeat_share <= rh, true) AS kept
FROM marked d LEFT JOIN fences f ON f.lang IS NOT DISTINCT FROM d.lang AND f.source IS NOT DISTINCT FROM d.source"""


@query("op7_quality_rules", r"""
WITH split AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split WHERE len(w) >= 5)),
reps AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM reps, range(0, 5) t(k) GROUP BY doc_id),
counted AS (SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words FROM split s LEFT JOIN cover c USING (doc_id)),""" + _FENCES)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document under thresholds of its language and source."""
    judged = judge_quality(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = ["assign", "access", "hex"]
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in base]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined_spans(F.col("spans"), base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


@query("op9_token_output")
def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every training sequence with its slot, its place in the shards and the documents in it."""
    return write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that stand in several documents, and which of them go."""
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), "words", "removed", "components")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, form and root."""
    return spelling_groups(counted_words(table(spark, sf_dir, "documents"), slip=199))


@query("op13_neighbours")
def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every 20th."""
    found = nearest_neighbours(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
