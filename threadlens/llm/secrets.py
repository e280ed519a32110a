"""Secret scan with a trigram inverted index.

Every rule is a regular expression. From its parse tree follows a Boolean query over trigrams in lower case: a sequence
needs the trigrams of each of its parts, a choice those of one branch. The index holds, for each trigram that a query
names, the rows whose text has it. The postings of the trigrams of a query are intersected; only rows that are left
are searched with the expression. A rule without a mandatory trigram is searched for in all rows.

Everything is a column expression. Places count characters (code points), the end is exclusive. Matches of a rule are
taken from the left without overlap, and those whose checked group is shorter than the rule asks are dropped.

Defined cases: a NULL text is empty and has no span; repeated rows have the same spans; rows are told apart by a hash of
id and text, and rows that share it only share candidates, not spans; an empty table gives no rows; a text may be of any
length; other columns are kept by ``redact_secrets`` and not read by ``find_secrets``.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser as sre_parse
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.lookup import bind


class Rule(NamedTuple):
    """A kind of secret: expression, group whose length counts, and the least length of it."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


#: What stands between the lines of a key, also in source code and quoted mail.
_BETWEEN = r"""(?:[\s"',>]|\\[nr])"""
#: A private key: up to its END line or, where that is missing, the base64 lines after the header, the last of which may
#: be short. Possessive, so that Java matches a body of any length without recursion.
_PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_BETWEEN}*+(?:Proc-Type|DEK-Info):[\x20\t]*+[^\s\\]*+)*+(?:{_BETWEEN}++[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+"
    rf"(?:{_BETWEEN}++[A-Za-z0-9+/]{{1,15}}+={{1,2}}+|(?:[\x20\t\r]*+\n|\\n)[\x20\t>]*+[A-Za-z0-9+/]{{1,15}}+[\x20\t]*+(?![^\r\n\\\"']))?+)"
)
#: Expressions of the base kinds and of well-known public key formats, in the order of their listing.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # as [0-9a-f]+ of 32 or more: a run is taken whole
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", _PRIVATE_KEY),
]
MASK = "[SECRET]"
#: A set of strings larger than this is not multiplied out further.
_STRINGS = 64


def _strings(node) -> set[str] | None:
    """All strings (lower case) a part of an expression can match, or None if there are too many."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 16:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 16 else None
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.BRANCH:
        branches = [_sequence_strings(b) for b in arg[1]]
        return None if None in branches else set().union(*branches)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
        one = _sequence_strings(arg[2])
        if one is None:
            return None
        out, power = set(), {""}
        for n in range(arg[1] + 1):
            out |= power if n >= arg[0] else set()
            power = {a + b for a in power for b in one}
            if len(power) > _STRINGS:
                return None
        return out
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _strings(node)
        if one is None or len(out) * len(one) > _STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _simplest(clauses: set[frozenset[str]]) -> set[frozenset[str]]:
    """Without clauses that ask for more than another one."""
    return {c for c in clauses if not any(d < c for d in clauses)}


def _query(nodes) -> set[frozenset[str]]:
    """Clauses of which one must hold; all trigrams of a clause must be there. An empty clause holds always."""
    whole, run = {frozenset()}, {""}

    def meet(clauses: set[frozenset[str]]) -> None:
        nonlocal whole
        whole = _simplest({a | b for a in whole for b in clauses})

    for node in [*nodes, None]:
        one = _strings(node) if node else None
        if one is not None and len(run) * len(one) <= _STRINGS:
            run = {a + b for a in run for b in one}
            continue
        meet({_grams(s) for s in run})
        run = one or {""}
        if one is None and node:
            op, arg = node
            if op is sre.SUBPATTERN:
                meet(_query(arg[3]))
            elif op is sre.BRANCH:
                meet(_simplest(set().union(*(_query(b) for b in arg[1]))))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                meet(_query(arg[2]))
    return whole


def trigram_query(pattern: str) -> list[list[str]]:
    """The query of an expression as sorted clauses; no clause at all if some match needs no trigram."""
    clauses = _query(sre_parse.parse(pattern))
    return [] if frozenset() in clauses else sorted(sorted(c) for c in clauses)


def trigram_postings(docs: DataFrame, grams: list[str], key: Column, text: Column) -> DataFrame:
    """The inverted index: ``gram`` (its number in ``grams``) and ``key`` of every row whose text has it."""
    lower = F.lower(text)
    present = F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return docs.select(key.alias("key"), F.explode(present).alias("gram"))


def candidates(postings: DataFrame, grams: list[str], rules: list[Rule]) -> DataFrame:
    """key, rules: the rows left for each rule by intersecting the postings of its trigrams.

    The clauses (a few rows per rule) are broadcast; a row of the index has one posting per trigram, so the groups are
    as small as the queries.
    """
    place = {g: i for i, g in enumerate(grams)}
    rows = [(r, c, place[g], 1 << n, (1 << len(clause)) - 1)
            for r, rule in enumerate(rules) for c, clause in enumerate(trigram_query(rule.pattern)) for n, g in enumerate(clause)]
    # Literals: rows given from Python would pass through Python workers of their own, which stay in every executor.
    listed = F.array(*[F.struct(*map(F.lit, r)) for r in rows]).cast("array<struct<rule:int,clause:int,gram:int,bit:bigint,full:bigint>>")
    named = postings.sparkSession.range(0, 1, 1, 1).select(F.inline(listed))
    held = postings.join(F.broadcast(named), "gram").groupBy("key", "rule", "clause").agg(F.bit_or("bit").alias("bits"), F.first("full").alias("full"))
    return held.where("bits = full").groupBy("key").agg(F.collect_set("rule").alias("rules"))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind number, end) of the matches of a rule.

    The text between matches, taken by splitting, and the matches themselves add up to the places.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    checked = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.length(g))
    between = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def placed(m: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            span = F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x["size"]).alias("end"))
            return F.struct((start + x["size"]).alias("at"), F.when(x["checked"] >= rule.at_least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

        parts = bind(F.struct(checked.alias("c"), between.alias("b")), lambda s: F.transform(
            m, lambda x, i: F.struct(F.get(s["b"], i).alias("gap"), F.length(x).alias("size"), F.get(s["c"], i).alias("checked"))))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])

    return bind(matches, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(empty))


def with_secrets(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__spans``, sorted by start and kind. The rows meet their candidates by one exchange on the key."""
    text = F.coalesce(docs[text_col], F.lit(""))
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for clause in q for g in clause})
    key = F.xxhash64(docs[id_col], docs[text_col])
    found = candidates(trigram_postings(docs, grams, key, text), grams, rules).select(F.col("key").alias("__key"), F.col("rules").alias("__rules"))
    joined = docs.withColumn("__row", key).join(found, F.col("__row") == F.col("__key"), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = [spans_of(text, r, n) if not queries[n] else F.when(F.array_contains("__rules", F.lit(n)), spans_of(text, r, n)).otherwise(none) for n, r in enumerate(rules)]
    return joined.withColumn("__spans", F.sort_array(F.concat(*parts))).drop("__row", "__key", "__rules")


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``spans``: an array of (kind, start, end) of every row, by start and then by the order of the rules."""
    rules = rules or RULES
    names = F.array(*[F.lit(r.kind) for r in rules])
    picked = docs.select(id_col, text_col)
    return with_secrets(picked, rules, id_col, text_col).select(F.col(id_col).alias("id"), F.transform("__spans", lambda s: F.struct(
        F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def redact_secrets(docs: DataFrame, rules: list[Rule] | None = None, mask: str = MASK, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret replaced by ``mask``; overlapping spans by one. ``length_col`` follows the new text."""
    marked = with_secrets(docs, rules or RULES, id_col, text_col)

    def clean(x: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            gap = F.substr(x["t"], state["at"] + 1, s["start"] - state["at"])
            more = F.struct(s["end"].alias("at"), F.concat(state["out"], gap, F.lit(mask)).alias("out"))
            wider = F.struct(F.greatest(s["end"], state["at"]).alias("at"), state["out"].alias("out"))
            return F.when(s["start"] >= state["at"], more).otherwise(wider)

        return F.aggregate(x["s"], F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                           lambda a: F.concat(a["out"], F.substr(x["t"], a["at"] + 1, F.length(x["t"]))))

    text = bind(F.struct(F.col(text_col).alias("t"), F.col("__spans").alias("s")), lambda x: F.when(F.size(x["s"]) > 0, clean(x)).otherwise(x["t"]))
    out = marked.withColumn(text_col, text)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.size("__spans") > 0, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)


def joined_spans(spans: Column, kinds: list[str] | None = None) -> Column:
    """The spans (of some kinds) as kind:start:end, joined by commas."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
