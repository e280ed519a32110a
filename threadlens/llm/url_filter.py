"""URL filter: a trie of rules over reversed host labels and path segments, the longest fitting rule decides.

A rule is a host, a path and a verdict. It fits its host and all subdomains where the path of the URL starts with its
path. Among fitting rules the one with the longer host wins, then the one with the longer path, whether it allows or
blocks; where a host and path are given twice, block wins.

Defined cases: a NULL URL, or one without ``://``, has an empty host and path and gets the default verdict; the host
keeps ports and user names as they are written; a URL without path fits only rules whose path is empty. Repeated rows
are judged alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import ship

#: More rules than this are not broadcast but joined; both ways give the same rows.
MAX_TRIE_RULES = 500_000


def url_host(url: Column) -> Column:
    """Host as written after the first ``://``, A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


class RuleTrie:
    """Nodes are dictionaries: labels of the host from the top-level domain down, then whole segments of the path.

    A rule ends at a node under ``None`` with the rest of its path, the beginning of the next segment.
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.hosts: dict = {}
        for host, path, verdict in rules:
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, tail = path.split("/")
            node = node.setdefault(None, {})
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            if ends.get(tail, (None, None))[1] != "block":
                ends[tail] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that decides, with its verdict."""
        at, nodes = self.hosts, []
        for label in reversed(host.split(".")):
            at = at.get(label)
            if at is None:
                break
            if None in at:
                nodes.append(at[None])
        segments = path.split("/")
        for node in reversed(nodes):
            best = None
            for i, segment in enumerate(segments):
                for length in range(len(segment) + 1) if None in node else ():
                    best = node[None].get(segment[:length], best)
                if i + 1 == len(segments) or segment not in node:
                    break
                node = node[segment]
            if best:
                return best
        return None


def _judge_by_trie(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    ship(urls.sparkSession)
    shared = urls.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in parts:
            found = [trie.find(h, p) or (None, None) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return urls.withColumn("__found", F.pandas_udf(judge, "rule string, verdict string")("host", "path")).select(
        *urls.columns, "__found.rule", "__found.verdict")


def _judge_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same without a broadcast: every suffix of the host and every beginning of the path is looked up.

    The keys of one URL are as many as its labels times the characters of its path; they are joined with the rules
    and the best is kept by a maximum, which Spark also builds before the exchange.
    """
    keyed = urls.withColumn("__row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = keyed.select("__row", F.explode(hosts).alias("__host"), "path").select("__row", "__host", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))).alias("__path"))
    named = rules.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "verdict")
    best = keys.join(named, ["__host", "__path"]).groupBy("__row").agg(F.max(F.struct(
        F.size(F.split("__host", r"\.")), F.length("__path"), F.col("verdict") == "block",
        F.concat("__host", "__path").alias("rule"), "verdict")).alias("__best"))
    return keyed.join(best, "__row", "left").select(*urls.columns, F.col("__best.rule"), F.col("__best.verdict"))


def filter_urls(
    urls: DataFrame,
    rules: DataFrame | list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_trie_rules: int = MAX_TRIE_RULES,
) -> DataFrame:
    """Id, host, path, the deciding rule (NULL if none fits) and the verdict (``default`` if none fits).

    ``rules`` has the columns host, path and verdict. Up to ``max_trie_rules`` of them are brought into one trie,
    which is broadcast; the size is checked before. More are joined.
    """
    spark: SparkSession = urls.sparkSession
    parts = urls.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    if isinstance(rules, list):
        few = rules
        rules = None if len(few) <= max_trie_rules else spark.createDataFrame(few, "host string, path string, verdict string")
    else:
        rules = rules.select("host", "path", "verdict").distinct()
        head = rules.limit(max_trie_rules + 1).collect()
        few = [tuple(r) for r in head]
    judged = _judge_by_trie(parts, few) if len(few) <= max_trie_rules else _judge_by_join(parts, rules)
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
