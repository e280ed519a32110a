"""Lexicon sentiment, scored inside each row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens import constants as K
from threadlens.functions.lookup import INLINE_LIMIT, bind, inline_lookup, unique_keys
from threadlens.operators.skew import join_unique

WORDS = r"[\p{L}\p{N}']+"
#: Lexicon rows up to which a joined lexicon is sent to every task (about 20 MB); a larger one is exchanged by word.
BROADCAST_LIMIT = 200_000
#: Column of each score.
OUTS = {"valence": "vader_score", "polarity": "textblob_score"}


@dataclass(frozen=True)
class ValenceRules:
    """Words and switches of the valence method."""

    negators: tuple[str, ...] = K.NEGATORS
    strengtheners: tuple[str, ...] = K.STRENGTHENERS
    weakeners: tuple[str, ...] = K.WEAKENERS
    contrast: str = "but"
    emphasis: bool = True  # capitals, '!' and '?'; cleaned text has none of them


@dataclass(frozen=True)
class Lexicon:
    """A word table ready for scoring: fetched once if it may travel inside the plan, else kept as a table.

    Entries of several words (up to ``phrase_words``, parted by one space) are idioms. A lexicon with idioms is
    joined: to try every run of words inside the row costs more than the join, whose steps are compiled.
    """

    table: DataFrame
    lookup: Callable[[Column], Column] | None
    phrase_words: int = 1

    @classmethod
    def of(cls, lexicon_df: DataFrame, inline_limit: int = INLINE_LIMIT, phrase_words: int = 1) -> Lexicon:
        """Prepare ``lexicon_df(word, valence)``; several scores over it then share one fetch."""
        table = lexicon_df.select("word", F.col("valence").cast("double").alias("valence"))
        return cls(table, inline_lookup(table, "word", "valence", inline_limit) if phrase_words == 1 else None, phrase_words)


def _boost(word: Column, rules: ValenceRules) -> Column:
    return (F.when(word.isin(*rules.strengtheners), K.BOOSTER_STEP)
            .when(word.isin(*rules.weakeners), -K.BOOSTER_STEP).otherwise(0.0))


def _turn(word: Column, rules: ValenceRules) -> Column:
    negated = word.isin(*rules.negators) | F.contains(word, F.lit("n't"))
    return F.when(negated, K.NEGATION_SCALAR).otherwise(1.0)


def _is_upper(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def _with_context(valence: Column, before: list[Column], rules: ValenceRules) -> Column:
    """The valence of a word after the boosters and negators in the words before it, nearest first."""
    steps = F.array(*[
        F.struct((_boost(w, rules) * damp).alias("add"), _turn(w, rules).alias("times"))
        for w, damp in zip(before, K.LOOKBACK_DAMPING)])
    return F.aggregate(steps, valence, lambda acc, s: (acc + F.signum(acc) * F.coalesce(s["add"], F.lit(0.0)))
                       * F.coalesce(s["times"], F.lit(1.0)))


def _punctuation(text: Column) -> Column:
    def count(mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    asked = count("?")
    return F.least(count("!"), F.lit(4)) * K.EXCLAMATION_STEP + (
        F.when(asked <= 1, 0.0).when(asked <= 3, asked * K.QUESTION_STEP).otherwise(K.QUESTION_TOP))


def _compound(total: Column, marks: Column, rules: ValenceRules) -> Column:
    """Sum of valences and emphasis of the marks -> score in [-1, 1]."""
    if rules.emphasis:
        total = total + F.signum(total) * marks
    score = total / F.sqrt(total * total + F.lit(K.VALENCE_ALPHA))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(score, 4))).cast("float")


def _text_facts(text: Column) -> Column:
    """The words of a text as written and in lower case, and whether only some are in capitals."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    return bind(words, lambda ws: bind(F.size(F.filter(ws, _is_upper)), lambda shouted: F.struct(
        ws.alias("words"), F.transform(ws, F.lower).alias("low"),
        ((shouted > 0) & (shouted < F.size(ws))).alias("mixed"))))


def _context(facts: Column, turn: Column, i: Column, rules: ValenceRules) -> list[Column]:
    """For the word at place ``i``: the three words before it, its capitals step, its contrast factor."""
    caps = F.when(facts["mixed"] & _is_upper(F.get(facts["words"], i)), K.CAPITALS_STEP).otherwise(0.0)
    place = i + 1  # counted like ``turn``, which is 0 without a contrast word
    side = F.when((turn == 0) | (place == turn), 1.0).when(place < turn, 0.5).otherwise(1.5)
    return [
        *[F.get(facts["low"], i - d).alias(f"b{d}") for d in (1, 2, 3)],
        (caps if rules.emphasis else F.lit(0.0)).alias("caps"),
        side.alias("side"),
    ]


def _valence_of(item: Column, valence: Column, rules: ValenceRules) -> Column:
    raised = valence + F.signum(valence) * item["caps"]
    return _with_context(raised, [item["b1"], item["b2"], item["b3"]], rules) * item["side"]


def _is_modifier(word: Column, rules: ValenceRules) -> Column:
    return word.isin(*rules.strengtheners, *rules.weakeners)


def _hits(low: Column, lexicon: Lexicon) -> Column:
    """The entries found in the words of a text: place, number of words, valence."""
    found = F.transform(low, lambda word, i: F.struct(i.alias("i"), F.lit(1).alias("len"), lexicon.lookup(word).alias("v")))
    return F.filter(found, lambda h: h["v"].isNotNull())


def _summed(hits: Column, value: Callable[[Column], Column], phrase_words: int) -> Column:
    """Sum and number of the hits' values in their order; a hit inside an idiom that counts is left out, and so is
    one without a value."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("free"))

    def add(acc: Column, hit: Column) -> Column:
        taken = bind(value(hit), lambda v: F.when(v.isNull(), acc).otherwise(F.struct(
            (acc["sum"] + v).alias("sum"), (acc["n"] + 1).alias("n"), (hit["i"] + hit["len"]).alias("free"))))
        return F.when(hit["i"] < acc["free"], acc).otherwise(taken) if phrase_words > 1 else taken

    return F.aggregate(hits, start, add)


def _mean(summed: Column) -> Column:
    return F.when(summed["n"] == 0, 0.0).otherwise(summed["sum"] / summed["n"]).cast("float")


def _score_inline(df: DataFrame, text_col: str, lexicon: Lexicon, outs: dict[str, str], rules: ValenceRules) -> DataFrame:
    text = F.col(text_col)

    def valence(facts: Column, hits: Column) -> Column:
        # A booster counts through the words after it, not by itself; only hits go on to the costlier context rules.
        own = F.filter(hits, lambda h: ~_is_modifier(F.get(facts["low"], h["i"]), rules))
        total = bind(F.array_position(facts["low"], F.lit(rules.contrast)).cast("int"), lambda turn: _summed(own, lambda h: bind(
            F.struct(*_context(facts, turn, h["i"], rules)), lambda item: _valence_of(item, h["v"], rules)), lexicon.phrase_words))
        return bind(total, lambda t: _compound(t["sum"], _punctuation(text), rules))

    def scores(facts: Column) -> Column:
        each = {
            "valence": lambda hits: valence(facts, hits),
            "polarity": lambda hits: bind(_summed(hits, lambda h: h["v"], lexicon.phrase_words), _mean),
        }
        return bind(_hits(facts["low"], lexicon), lambda hits: F.struct(*[each[method](hits).alias(method) for method in outs]))

    if "valence" in outs:
        facts = _text_facts(text)
    else:
        facts = F.struct(F.transform(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.lower).alias("low"))
    found = bind(facts, scores)
    if len(outs) == 1:
        (method, out), = outs.items()
        return df.withColumn(out, F.when(text.isNotNull(), found[method]))
    # Two columns read the structure, so Spark computes it once, below them.
    scored = df.withColumn("_scores", F.when(text.isNotNull(), found))
    return scored.withColumns({out: F.col("_scores")[method] for method, out in outs.items()}).drop("_scores")


def _place_code(words: Column, low: Column, mixed: Column, turn: Column, i: Column, rules: ValenceRules) -> Column:
    """:func:`_context` of the word at place ``i`` as one int, to travel with the word: three bits for each of the three words
    before it (2 for a booster's kind, 1 for a negator), a bit for its capitals and two for its contrast factor."""

    def kind(word: Column) -> Column:
        boost = F.when(word.isin(*rules.strengtheners), 1).when(word.isin(*rules.weakeners), 2).otherwise(0)
        return boost.bitwiseOR(F.when(word.isin(*rules.negators) | F.contains(word, F.lit("n't")), 4).otherwise(0))

    code = F.lit(0)
    for d in (1, 2, 3):
        code = code.bitwiseOR(F.shiftleft(kind(F.get(low, i - d)), 3 * (d - 1)))
    if rules.emphasis:
        code = code.bitwiseOR(F.when(mixed & _is_upper(F.get(words, i)), 1 << 9).otherwise(0))
    place = i + 1
    return code.bitwiseOR(F.when((turn == 0) | (place == turn), 0).when(place < turn, 1 << 10).otherwise(2 << 10))


def _with_valence(hits: DataFrame, rules: ValenceRules) -> DataFrame:
    """Add ``_valence``, what :func:`_valence_of` gives for ``_v`` in the context of ``_code``; NULL for a booster by itself."""

    def bits(at: int, mask: int) -> Column:
        return F.shiftright("_code", at).bitwiseAND(mask)

    hits = hits.withColumn("_valence", F.when(~((F.col("_len") == 1) & _is_modifier(F.col("_w"), rules)), F.col("_v")))
    hits = hits.withColumn("_valence", F.col("_valence") + F.signum("_valence") * F.when(bits(9, 1) == 1, K.CAPITALS_STEP).otherwise(0.0))
    for d, damp in enumerate(K.LOOKBACK_DAMPING):
        boost = F.when(bits(3 * d, 3) == 1, K.BOOSTER_STEP).when(bits(3 * d, 3) == 2, -K.BOOSTER_STEP).otherwise(0.0) * damp
        times = F.when(bits(3 * d, 4) == 4, K.NEGATION_SCALAR).otherwise(1.0)
        hits = hits.withColumn("_valence", (F.col("_valence") + F.signum("_valence") * boost) * times)
    side = F.when(bits(10, 3) == 0, 1.0).when(bits(10, 3) == 1, 0.5).otherwise(1.5)
    return hits.withColumn("_valence", F.col("_valence") * side)


def _join_lexicon(items: DataFrame, table: DataFrame) -> DataFrame:
    small = table.limit(BROADCAST_LIMIT + 1).count() <= BROADCAST_LIMIT
    return items.join(F.broadcast(table), "_w") if small else join_unique(items, table, "_w")


def _score_joined(df: DataFrame, text_col: str, lexicon: Lexicon, outs: dict[str, str], rules: ValenceRules) -> DataFrame:
    """The same scores by joining words (and runs of words, for idioms) with the lexicon: equal texts, told by a
    digest, are scored once, and the values of a text are added in the order of its words. A word is a row of its place
    and a number for its context; the text itself is not read again after the words are taken."""
    marks = _punctuation(F.col(text_col)) if rules.emphasis else F.lit(0.0)
    keyed = df.withColumns({"_key": F.md5(text_col), "_marks": marks})
    table = unique_keys(lexicon.table, "word", "valence").select(F.col("word").alias("_w"), F.col("valence").alias("_v"))
    texts = keyed.filter(F.col("_key").isNotNull()).select("_key", F.col(text_col).alias("_text")).dropDuplicates(["_key"])
    words, low, mixed, i = F.col("_f.words"), F.col("_f.low"), F.col("_f.mixed"), F.col("_i")
    facts = texts.select("_key", _text_facts(F.col("_text")).alias("_f")).select(
        "_key", "_f", F.array_position(low, F.lit(rules.contrast)).cast("int").alias("_turn"))
    code = _place_code(words, low, mixed, F.col("_turn"), i, rules) if "valence" in outs else F.lit(0)
    items = facts.select("_key", "_f", "_turn", F.posexplode(low).alias("_i", "_w")).select("_key", "_f", "_i", "_w", code.alias("_code"))
    if lexicon.phrase_words > 1:
        sizes = F.array(*[F.lit(n) for n in range(1, lexicon.phrase_words + 1)])
        run = F.concat_ws(" ", "_w", *[F.when(F.col("_len") > k, F.get(low, i + k)) for k in range(1, lexicon.phrase_words)])
        items = (items.select("*", F.explode(sizes).alias("_len")).where(i + F.col("_len") <= F.size(low))
                 .withColumn("_w", F.when(F.col("_len") == 1, F.col("_w")).otherwise(run)))
    else:
        items = items.withColumn("_len", F.lit(1))
    hits = _join_lexicon(items.select("_key", "_i", "_len", "_code", "_w"), table)
    if "valence" in outs:
        hits = _with_valence(hits, rules)
    value = {"valence": "_valence", "polarity": "_v"}
    hit = F.struct(F.col("_i").alias("i"), (-F.col("_len")).alias("less"), F.col("_len").alias("len"), *[F.col(value[m]).alias(m) for m in outs])
    found = hits.groupBy("_key").agg(F.sort_array(F.collect_list(hit)).alias("_hits"))
    sums = found.select("_key", *[_summed(F.col("_hits"), lambda h, m=m: h[m], lexicon.phrase_words).alias(f"_sum_{m}") for m in outs])
    scores = {
        "valence": _compound(F.coalesce(F.col("_sum_valence.sum"), F.lit(0.0)), F.col("_marks"), rules),
        "polarity": F.coalesce(_mean(F.col("_sum_polarity")), F.lit(0.0).cast("float")),
    }
    joined = keyed.join(sums, "_key", "left")
    return joined.withColumns({out: F.when(F.col("_key").isNotNull(), scores[m]) for m, out in outs.items()}).drop("_key", "_marks", *[f"_sum_{m}" for m in outs])


def _score(df: DataFrame, text_col: str, lexicon: Lexicon, outs: dict[str, str], rules: ValenceRules) -> DataFrame:
    way = _score_joined if lexicon.lookup is None else _score_inline
    return way(df, text_col, lexicon, outs, rules)


def score_sentiment(
    df: DataFrame,
    text_col: str,
    lexicon_df: DataFrame | Lexicon,
    method: str = "valence",
    out: str | None = None,
    rules: ValenceRules = ValenceRules(),
    inline_limit: int = INLINE_LIMIT,
) -> DataFrame:
    """Add a sentiment score of ``text_col`` from ``lexicon_df(word, valence)``; NULL text gives NULL.

    ``valence``: every word of the lexicon counts with its valence, raised or lowered by boosters and turned
    by negators among the three words before it; words before the contrast word count half, those after it
    one and a half times. Capitals and marks add emphasis. The sum s becomes s / sqrt(s^2 + 15).
    ``polarity``: the mean valence of the words found, 0 if there are none.

    Up to ``inline_limit`` lexicon rows the words are looked up inside the row: a narrow step, whatever the
    size of ``df``. A larger lexicon, or one with idioms, is joined word by word. Both ways give the same scores.

    An entry of several words (see :class:`Lexicon`) counts as a whole where it stands, the longest first, and the words
    in it do not count by themselves; the words before its first one are its context.
    """
    out = out or OUTS[method]
    lexicon = lexicon_df if isinstance(lexicon_df, Lexicon) else Lexicon.of(lexicon_df, inline_limit)
    return _score(df, text_col, lexicon, {method: out}, rules)


def score_both(df: DataFrame, text_col: str, lexicon_df: DataFrame | Lexicon, rules: ValenceRules = ValenceRules(), outs: dict[str, str] | None = None) -> DataFrame:
    """Both scores of :func:`score_sentiment` from one pass over the words of a text."""
    lexicon = lexicon_df if isinstance(lexicon_df, Lexicon) else Lexicon.of(lexicon_df)
    return _score(df, text_col, lexicon, outs or OUTS, rules)
