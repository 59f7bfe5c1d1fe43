import random
import re

import numpy as np
import pyarrow as pa

from orrery.llm import url_filter
from orrery.llm.url_filter import RULES, VOCABULARY, automaton, judge, occurrences, weigh

TERMS = {"ads": 1, "ad": 1, "adsense": 2, "win": 1, "a-win": 1, "x": 1, "né": 1}


def hits(url, vocabulary, limit=2):
    """(strict occurrences, different soft terms, weight) by looking for every term everywhere."""
    text = "".join(c.lower() if c.isascii() else c for c in url or "")
    joins = lambda c: c != "" and (ord(c) >= 0x80 or c.isalnum())
    found = []
    for term in vocabulary:
        for i in range(len(text)):
            if text.startswith(term, i) and not joins(text[i - 1 : i]) and not joins(text[i + len(term) : i + len(term) + 1]):
                found.append(term)
    different = set(found)
    return (
        sum(vocabulary[t] >= limit for t in found),
        sum(vocabulary[t] < limit for t in different),
        sum(vocabulary[t] for t in different),
    )


def verdict(url, rules, vocabulary):
    found = re.search("(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in found[1]), found[2]) if found else ("", "")
    fits = [(len(r), v, r) for v, r in rules for name, _, rest in [r.partition("/")] if f".{host}".endswith(f".{name}") and path.startswith(f"/{rest}")]
    if fits:
        return host, path, max(fits)[2], max(fits)[1]
    return host, path, None, "block" if hits(url, vocabulary)[2] >= 2 else "allow"


def test_the_automaton_finds_every_occurrence(monkeypatch):
    rng = random.Random(2)
    terms = [b"a", b"ab", b"bab", b"abba", b"b"]
    data = bytes(rng.choice(b"ab") for _ in range(400))
    want = sorted((i + len(t), k) for k, t in enumerate(terms) for i in range(len(data)) if data.startswith(t, i))
    for lane in (1, 3, 64, 1000):
        monkeypatch.setattr(url_filter, "LANE", lane)
        end, term = occurrences(automaton(terms), np.frombuffer(data, np.uint8))
        assert sorted(zip(end.tolist(), term.tolist(), strict=True)) == want
    assert occurrences(automaton([]), np.frombuffer(data, np.uint8))[0].size == 0


def test_weights_and_boundaries(monkeypatch):
    rng = random.Random(4)
    parts = ["ads", "Ad", "adsense", "a", "-", ".", "/", "win", "x", "né", "é", "0", "%", "http://", "\n", "A-WIN"]
    urls = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500)] + [None, "", "x" * 5000, "x/" * 5000]
    for lane in (5, 256):
        monkeypatch.setattr(url_filter, "LANE", lane)
        got = list(zip(*[a.to_pylist() for a in weigh(pa.array(urls), TERMS)], strict=True))
        assert got == [hits(u, TERMS) for u in urls]
    assert [a.to_pylist() for a in weigh(pa.array(urls[:2]), {})] == [[0, 0]] * 3


def test_rules_and_verdicts(spark):
    urls = [
        "https://a.example.org/es/1", "https://example.org/en/1", "https://example.org/en/21", "http://EXAMPLE.ORG", "http://example.org?x=/es/",
        "http://xorg/", "http://org/", "http://x.com/fr/casino", "http://x.com/de/1", "http://x.com/DE/1", "http://x.net/free-bets", "http://x.net/freebets",
        "http://free.net/?q=bets#win", "casino", "http://casinos.net", "//casino/", "a://b://c.org/", "://", "", None, "http://poker.org/", "http://x.org:80/",
    ]
    rows = [(1, i, u, "x", True) for i, u in enumerate(urls)] * 2 + [(1, None, "http://adult-x.com/", None, None)]
    pages = spark.createDataFrame(rows, "HOST int, page_id long, url string, verdict string, Rule boolean").repartition(3)
    got = judge(pages).collect()
    want = [(i, *verdict(u, RULES, VOCABULARY)) for _, i, u, _, _ in rows]
    assert sorted(map(str, [tuple(r[:5]) for r in got])) == sorted(map(str, want))
    by_id = {r.page_id: (r.rule, r.verdict) for r in got}
    assert by_id[0] == ("example.org/es/", "block") and by_id[2] == ("org/", "allow") and by_id[3] == (None, "allow")
    assert by_id[7] == ("com/fr/", "allow") and by_id[10][1] == by_id[13][1] == "block" and by_id[11][1] == "allow" and by_id[None][1] == "block"
    assert judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in judge(pages, rules=(), vocabulary={}).collect()} == {"allow"}
    both = (("block", "org/"), ("allow", "org/"))
    assert {r.verdict for r in judge(pages.where("page_id = 6"), both).collect()} == {"block"}
