import random

from pyspark.sql import functions as F

from threadlens.llm.url_filter import RuleTrie, filter_urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("example.com", "/en/private", "allow"),
         ("net", "", "block"), ("a.net", "/x", "allow"), ("a.net", "/x/y", "block")]


def brute(host, path):
    fits = [(h.count(".") + 1, len(p), v == "block", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else None


def test_trie_against_all_rules():
    rng, trie = random.Random(3), RuleTrie(RULES)
    for _ in range(3000):
        host = ".".join(rng.choice(["www", "example", "com", "net", "a", ""]) for _ in range(rng.randint(1, 4)))
        path = "".join(rng.choice(["/", "en", "x", "y", "private", "/en/", "/x/"]) for _ in range(rng.randint(0, 4)))
        assert trie.find(host, path) == brute(host, path), (host, path)


def test_trie_and_join_agree(spark):
    urls = ["http://www.Example.com/en/private/1?q#f", "https://example.com/EN/", "no scheme", None, "://", "x://net", "x://b.a.net/x/yy", "x://a.net/x/y", "x://com", "x://COM/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    small = sorted(filter_urls(pages, rules).collect(), key=lambda r: r[0])
    large = sorted(filter_urls(pages, rules, max_trie_rules=2).collect(), key=lambda r: r[0])
    listed = sorted(filter_urls(pages, RULES, max_trie_rules=2).collect(), key=lambda r: r[0])
    assert small == large == listed and len(small) == 11
    for r in small:
        assert (r.rule, r.verdict) == (brute(r.host, r.path) or (None, "allow"))
    assert small[3].host == "" and small[3].path == "" and small[0].host == "www.example.com"
    assert filter_urls(pages.limit(0), RULES).count() == 0
    assert filter_urls(pages.where(F.lit(False)), rules, max_trie_rules=0).count() == 0
