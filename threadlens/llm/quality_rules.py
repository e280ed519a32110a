"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Measures of a text are integers (shares in ten-thousandths). A sketch counts values in buckets of bounded relative
width (values below 64 exactly, else 32 buckets per power of two, so a quantile is at most 1/32 too low); sketches
merge by adding counts. For every language and source the quartiles give the fences ``q1 - SPREAD * iqr`` and
``q3 + SPREAD * iqr``, never closer to the quartiles than the margin of the measure; a text outside a fence goes. A pair
with fewer than ``min_rows`` rows takes the merged sketch of its language, and that failing, the one of all rows.

Everything is a column expression. Measures are stored (a few numbers a document), so texts are read once; counts are
built before the exchange, so a pair that holds a third of all rows sends its buckets only.

Defined cases: a NULL text has no word and fails the base rules; NULL languages and sources are values of their own; ties
share a bucket; repeated rows are judged alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.lookup import bind
from threadlens.llm.common import WORD
from threadlens.sources.sinks import store

SPREAD = 3
#: Measure -> (margin below, margin above); None: no fence on that side.
MARGINS: dict[str, tuple[int | None, int | None]] = {
    "word_length": (150, 500),  # hundredths of a character
    "symbol_share": (None, 1000),
    "dup_line_share": (None, 3000),
    "repeat_share": (None, 2000),
}
_WINDOW = 5


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text.

    Windows are told apart by a 64-bit hash. Texts without a repeated window (told by the distinct hashes) end there; in
    the others, hashes sorted with their places bring equal ones together, and the places cover five words each.
    """

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            repeated = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
            return F.sort_array(F.filter(repeated, lambda i: i.isNotNull()))

        start = F.struct(F.lit(-_WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(bind(placed, places), start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(_WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - _WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(_WINDOW)]))

    def count(w: Column) -> Column:
        some = bind(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(w) > _WINDOW, some).otherwise(F.lit(0).cast("long"))

    return bind(words, count)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source and the counts of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    sizes = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    counted = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("rep")))
    return docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        counted.alias("words"), sizes.alias("lines"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    ).select("id", "lang", "source", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"),
             F.col("lines.dup").alias("n_dup_lines"), F.col("words.rep").alias("n_repeat_words"))


def with_measures(counts: DataFrame) -> DataFrame:
    """The counts with the measures that have fences, and ``base_failed``."""
    return counts.select(
        "*",
        F.expr("coalesce(if(n_words = 0, 0, word_chars * 100 div n_words), 0)").alias("word_length"),
        F.expr("if(word_chars = 0, 0, n_symbols * 10000 div word_chars)").alias("symbol_share"),
        F.expr("if(n_lines = 0, 0, n_dup_lines * 10000 div n_lines)").alias("dup_line_share"),
        F.expr("if(n_words = 0, 0, n_repeat_words * 10000 div n_words)").alias("repeat_share"),
        F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words").alias("base_failed"),
    )


def bucket_of(value: Column) -> Column:
    """Bucket of a value of 0 or more."""
    shift = F.greatest(F.lit(0), F.length(F.bin(value)) - 6)
    return (shift * 32 + F.call_function("shiftright", value, shift)).cast("long")


def bucket_floor(bucket: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.greatest(F.lit(0), F.floor(bucket / 32) - 1).cast("int")
    return F.call_function("shiftleft", (bucket - shift * 32).cast("long"), shift)


def sketch(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """by, measure, bucket, n: the sketch of every measure for every value of ``by``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket_of(F.col(m)).alias("bucket")) for m in measures])
    return rows.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.measure", "p.bucket").agg(F.count("*").alias("n"))


def merge_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches brought together by fewer keys."""
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, measure, rows, q1, q3. A window sees the buckets of one sketch, at most 32 per power of two."""
    w = Window.partitionBy(*by, "measure")
    upto = sketches.withColumn("rows", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket")))
    quantile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * q, bucket_floor(F.col("bucket"))))
    return upto.groupBy(*by, "measure").agg(F.first("rows").alias("rows"), quantile(1).alias("q1"), quantile(3).alias("q3"))


def thresholds(measured: DataFrame, min_rows: int = 200) -> DataFrame:
    """lang, source, and ``fences``: a map from measure to its lower and upper fence."""
    fine = store(sketch(measured.where("NOT base_failed"), ["lang", "source"], list(MARGINS)), "sketches")
    coarse = quartiles(merge_sketches(fine, ["lang"]), ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("ml"), F.col("rows").alias("rows_l"), F.struct("q1", "q3").alias("of_lang"))
    whole = quartiles(merge_sketches(fine, []), []).select(F.col("measure").alias("ma"), F.struct("q1", "q3").alias("of_all"))
    own = quartiles(fine, ["lang", "source"]).withColumn("own", F.struct("q1", "q3"))
    joined = (own.join(coarse, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("ml")))
              .join(F.broadcast(whole), F.col("measure") == F.col("ma")))
    chosen = F.when(F.col("rows") >= min_rows, F.col("own")).when(F.col("rows_l") >= min_rows, F.col("of_lang")).otherwise(F.col("of_all"))
    iqr = F.col("q.q3") - F.col("q.q1")
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for name, (below, above) in MARGINS.items():
        here = F.col("measure") == name
        if below is not None:
            low = F.when(here, F.col("q.q1") - F.greatest(F.lit(below), SPREAD * iqr)).otherwise(low)
        if above is not None:
            high = F.when(here, F.col("q.q3") + F.greatest(F.lit(above), SPREAD * iqr)).otherwise(high)
    fences = joined.withColumn("q", chosen).select("lang", "source", "measure", low.alias("low"), high.alias("high"))
    return fences.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("low", "high")))).alias("fences"))


def judge_quality(docs: DataFrame, min_rows: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: its counts, measures, ``base_failed`` and ``kept``."""
    measured = with_measures(store(measure(docs, id_col, text_col, lang_col, source_col), "measures"))
    limits = thresholds(measured, min_rows).withColumnsRenamed({"lang": "l", "source": "s"})
    inside = F.lit(True)
    for name in MARGINS:
        fence = F.col("fences")[name]
        inside &= F.coalesce(F.col(name) >= fence["low"], F.lit(True)) & F.coalesce(F.col(name) <= fence["high"], F.lit(True))
    return (measured.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
            .withColumn("kept", ~F.col("base_failed") & inside).drop("l", "s", "fences"))
