"""Text expressions: cleaning, news source of a URL, phrases, tokens."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.lookup import INLINE_LIMIT, bind, inline_lookup, unique_keys
from threadlens.operators.skew import join_unique

_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*:"
_PLAIN = re.compile(r"[\w\s@&:;,!'\"/%#=<>~`-]*", re.UNICODE)


def clean_text(df: DataFrame, col: str = "body") -> DataFrame:
    """Lower-case ``col``, drop everything but ASCII letters, digits and white space, trim spaces."""
    kept = F.regexp_replace(F.lower(col), r"[^a-zA-Z0-9\s]", "")
    return df.withColumn(col, F.trim(kept))


def post_id(link_id: str | Column) -> Column:
    """Id of the post a comment belongs to; '' if the link names something else."""
    return F.regexp_extract(link_id, r"t3_(.*)$", 1)


def url_authority(url: Column) -> Column:
    """The authority part of a URL with user and port; '' if it has none."""
    return F.regexp_extract(url, rf"^(?:{_SCHEME})?//([^/?#]*)", 1)


def _after_first(text: Column, mark: str) -> Column:
    """What stands between the first ``mark`` and the next one."""
    return F.try_element_at(F.split(text, re.escape(mark)), F.lit(2))


def news_source(url: str | Column, strip_nested_scheme: bool = True) -> Column:
    """The news source a URL points at.

    * The domain is the URL's authority; for a www.google.com address it is that of the address after
      ``amp/s/``, or else after ``url=``; with neither the result is NULL.
    * The source is the first label of the domain, or the second after ``www`` or ``amp`` (NULL if
      there is none), in lower case.
    * For twitter.com it is the first path segment of the URL itself, as written.

    An address after ``url=`` often brings its own ``https://``. Reading on at that point would give
    the source ``https:``, so the scheme is removed; ``strip_nested_scheme=False`` keeps the old result.
    """
    url = F.col(url) if isinstance(url, str) else url
    nested = F.when(F.contains(url, F.lit("amp/s/")), _after_first(url, "amp/s/")).when(
        F.contains(url, F.lit("url=")), _after_first(url, "url="))
    if strip_nested_scheme:
        nested = F.regexp_replace(nested, rf"^{_SCHEME}//", "")

    def domain_of(authority: Column) -> Column:
        closed = F.contains(authority, F.lit("[")) == F.contains(authority, F.lit("]"))
        return F.when(~closed, None).when(
            F.contains(authority, F.lit("www.google.com")), F.regexp_extract(nested, r"^([^/?#]*)", 1)
        ).otherwise(authority)

    def label_of(domain: Column) -> Column:
        return bind(F.split(domain, r"\.", 3), lambda parts: F.when(
            F.get(parts, F.lit(0)).isin("www", "amp"), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))))

    def account_or(label: Column) -> Column:
        path = rf"^(?:{_SCHEME})?//[^/?#]*/"
        return F.when(url.rlike(path), F.regexp_extract(url, path + "([^/?#]*)", 1)).otherwise(label)

    # Each step is bound, so that a filter on the source, which Spark copies below the projection, parses
    # a URL once and not once per mention.
    return bind(bind(url_authority(url), domain_of), lambda domain: bind(label_of(domain), lambda label: F.when(
        label.isNotNull() & F.contains(domain, F.lit("twitter.com")), account_or(label)).otherwise(F.lower(label))))


#: Plain phrases from which on they are searched together; fewer are searched one by one, each faster than a pattern.
TOGETHER = 32


def _branches(node: dict) -> str:
    """A pattern for what may follow a node of a tree of letters: the longest way first."""
    ways = [letter + _branches(child) for letter, child in node.items() if letter]
    if not ways:
        return ""
    if "" in node:
        return f"(?:{'|'.join(ways)})?"
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def phrase_pattern(phrases: list[str]) -> str:
    """One pattern that matches the longest of the plain phrases at a place.

    The phrases share a tree by their first letters, so a place is given up after a letter or two, however many
    phrases there are.
    """
    tree: dict = {}
    for phrase in phrases:
        node = tree
        for letter in phrase:
            node = node.setdefault(letter, {})
        node[""] = {}
    return _branches(tree)


def found_phrases(col: str | Column, phrases: list[str]) -> Column:
    """The distinct phrases that occur in the text, as an array; all are searched in one pass over it. NULL gives NULL.

    Phrases are plain and not empty. At every place, also inside a match, the longest one is found; those that it begins
    with occur there too and are added.
    """
    col = F.col(col) if isinstance(col, str) else col
    known = set(phrases)
    begun = {p: [p[:k] for k in range(1, len(p)) if p[:k] in known] for p in phrases}
    begun = {p: shorter for p, shorter in begun.items() if shorter}
    found = F.array_distinct(F.regexp_extract_all(col, F.lit(f"(?=({phrase_pattern(phrases)}))"), F.lit(1)))
    if not begun:
        return found
    table = F.from_json(F.lit(json.dumps(begun)), "map<string,array<string>>")
    return bind(found, lambda ps: F.array_distinct(F.concat(ps, F.flatten(F.transform(ps, lambda p: F.coalesce(table[p], F.array().cast("array<string>")))))))


def part_phrases(phrases) -> tuple[list[str], list[str]]:
    """Distinct phrases: those to search together (none if they are few), and the others."""
    distinct = list(dict.fromkeys(phrases))
    plain = [p for p in distinct if p and _PLAIN.fullmatch(p)]
    if len(plain) < TOGETHER:
        return [], distinct
    return plain, [p for p in distinct if p not in set(plain)]


def matches_any(col: str | Column, phrases: tuple[str, ...] | list[str]) -> Column:
    """TRUE if any phrase occurs in the text; NULL for a NULL text.

    Phrases are regular expressions. Plain ones are searched as substrings, which is the same test and
    needs no regex engine, or by one pattern if they are many; the rest form one alternation.
    """
    col = F.col(col) if isinstance(col, str) else col
    together, others = part_phrases(phrases)
    plain = [p for p in others if _PLAIN.fullmatch(p)]
    patterns = [p for p in others if not _PLAIN.fullmatch(p)]
    tests = [F.contains(col, F.lit(p)) for p in plain]
    if together:
        tests.append(col.rlike(phrase_pattern(together)))
    if patterns:
        tests.append(col.rlike("|".join(patterns)))
    return reduce(or_, tests)


def flag_phrases(df: DataFrame, text_col: str, phrases, out: str = "misinfo_class") -> DataFrame:
    """Add a flag that is TRUE if any phrase occurs in the text and FALSE otherwise, also for NULL."""
    return df.withColumn(out, F.coalesce(matches_any(text_col, phrases), F.lit(False)))


def term_dummies(df: DataFrame, text_col: str, terms) -> DataFrame:
    """Add one 0/1 column per distinct term: does the text contain it, upper and lower case apart?

    The test is for substrings, so ``us`` is found in ``industry``. Many terms are found in one pass over the
    text, of which all their columns are read.
    """
    together, others = part_phrases(terms)
    tests = {t: F.array_contains("_found", t) for t in together} | {t: matches_any(text_col, [t]) for t in others}
    if together:
        df = df.withColumn("_found", found_phrases(text_col, together))
    return df.withColumns({
        t: F.coalesce(tests[t], F.lit(False)).cast("int") for t in dict.fromkeys(terms)
    }).drop("_found")


def tokenize(df: DataFrame, col: str, out: str = "words") -> DataFrame:
    """Lower-case words split at every white-space character; inner empty words stay, trailing ones go."""
    text = F.regexp_replace(F.lower(col), r"\s+$", "")
    words = F.split(text, r"\s")
    only_space = (text == "") & (F.length(col) > 0)
    return df.withColumn(out, F.when(only_space, F.array().cast("array<string>")).otherwise(words))


def normalize_tokens(df: DataFrame, col: str, out: str = "tokens", keep: str = r"\p{L}") -> DataFrame:
    """Lower-case words in which only the characters of the class ``keep`` are left; empty words go.

    The class is applied to the whole text before it is split: one regex pass per text, not one per word.
    """
    text = F.regexp_replace(F.lower(col), rf"[^{keep}\s]", "")
    return df.withColumn(out, F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def remove_stop_words(df: DataFrame, col: str, words, out: str | None = None) -> DataFrame:
    """Drop the words of an array that are in the list, whatever their case; repeats of others stay."""
    banned = sorted({w.lower() for w in words})
    return df.withColumn(out or col, F.filter(F.col(col), lambda w: ~F.lower(w).isin(banned)))


def lemmatize(df: DataFrame, tokens_col: str, lemma_df: DataFrame, out: str = "lemmas", inline_limit: int = INLINE_LIMIT) -> DataFrame:
    """Replace every word by its lemma from ``lemma_df(form, lemma)``; unknown words stay, a NULL array too.

    A table within the inline bound is looked up inside each row. A larger one is joined on the word
    (Catalyst and AQE choose how); the words return to their text by a digest of the words, so that equal
    texts are looked up once and no id is needed. Both ways give the same rows.
    """
    lookup = inline_lookup(lemma_df, "form", "lemma", inline_limit)
    if lookup is not None:
        return df.withColumn(out, F.transform(tokens_col, lambda w: F.coalesce(lookup(w), w)))
    lemmas = unique_keys(lemma_df, "form", "lemma")
    keyed = df.withColumn("_key", F.md5(F.to_json(tokens_col)))
    placed = keyed.select("_key", F.col(tokens_col).alias("_t")).dropDuplicates(["_key"]).select("_key", F.posexplode("_t").alias("_pos", "form"))
    words = (join_unique(placed, lemmas, "form", "left")
             .groupBy("_key")
             .agg(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("lemma", "form").alias("w")))).alias("_w"))
             .select("_key", F.transform("_w", lambda p: p["w"]).alias("_found")))
    empty = F.when(F.col(tokens_col).isNotNull(), F.array().cast("array<string>"))
    return keyed.join(words, "_key", "left").withColumn(out, F.coalesce("_found", empty)).drop("_key", "_found")
