import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import divergence as dv
from orrery.llm import words
from orrery.llm.divergence import Leaves, divergence, radix_order, shares_of

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute_force(rows, least=3, top=200):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (other, s), c in counts.items() if other == lang}
        whole = sum(groups.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept))
        shares = {s: {t: p(c, t) for t in kept} for s, c in groups.items()}
        q = {t: p(whole, t) for t in kept}
        for s in groups:
            pairs = [(-sum((shares[s][t] - shares[o][t]) ** 2 // shares[o][t] for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-((shares[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[s][t] and shares[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture
def tiny(monkeypatch):
    for module, name, value in (
        (words, "SHARD_BYTES", 700), (words, "WINDOW_BYTES", 61), (dv, "TWIG_LEAVES", 5), (dv, "PAGE_LEAVES", 3), (dv, "RANGE_LEAVES", 20),
        (dv, "MERGE_LEAVES", 9), (dv, "BLOCK_SOURCES", 2), (dv, "HELD_SUMS", 5),
    ):
        monkeypatch.setattr(module, name, value)


def text(rng):
    return " ".join("".join(rng.choice("abAé") for _ in range(rng.randrange(1, 4))) + rng.choice(["", ",", "1", "_x"]) for _ in range(rng.randrange(12)))


def test_the_trie_is_traversed_in_byte_order():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(9))) for _ in range(400)} | {b"x" * 50, b"x" * 49})
    rng.shuffle(keys)
    order, shared = radix_order(pa.array(keys, pa.binary()))
    got = [keys[i] for i in order]
    assert got == sorted(keys)
    for before, key, n in zip(got, got[1:], shared[1:].tolist(), strict=False):
        assert before[:n] == key[:n] and before[n : n + 1] != key[n : n + 1]


def test_merging_adds_up_and_packing_loses_nothing():
    rng = np.random.default_rng(2)

    def trie(names):
        keys = sorted({bytes(rng.choice(list(b"abc"), rng.integers(1, 5))) for _ in range(30)})
        n = rng.integers(1, 9, 60)
        return Leaves(pa.array(keys, pa.binary()), rng.integers(1, 5, len(keys)), rng.integers(0, len(keys), 60), rng.integers(0, len(names), 60), n, names)

    def counts(t):
        return {(t.keys[i].as_py(), t.sources[t.source[j]]): int(t.count[j]) for i in range(len(t)) for j in range(t.at[i], t.at[i + 1])}

    tries = [trie(["x", "y"]), trie(["z", "x"]), trie(["y"])]
    merged = Leaves.merged(tries)
    assert merged.keys.to_pylist() == sorted({k for t in tries for k in t.keys.to_pylist()})
    assert counts(merged) == dict(sum((Counter(counts(t)) for t in tries), Counter()))
    docs = Counter()
    for t in tries:
        docs.update(dict(zip(t.keys.to_pylist(), t.docs.tolist(), strict=True)))
    assert dict(zip(merged.keys.to_pylist(), merged.docs.tolist(), strict=True)) == docs
    for lo, hi in ((0, len(merged)), (3, 17), (5, 6)):
        again = Leaves.unpacked(merged.packed(lo, hi), merged.sources)
        assert again.keys.to_pylist() == merged.keys.to_pylist()[lo:hi] and counts(again) == counts(merged.cut(lo, hi))


def test_shares_are_exact():
    n = np.array([0, 1, 7, 10**6, 9 * 10**14])
    of = np.int64(9 * 10**14 + 11)
    assert shares_of(n, of).tolist() == [1 + 10**9 * (int(c) + 1) // int(of) for c in n]


def test_results_equal_brute_force(spark, tiny):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", "é", None]), text(rng)) for _ in range(250)]
    rows += [("en", "s3", None), ("fr", "a", "once"), ("fr", "b", ""), ("e\0n", "s0", "ab"), ("de", "s0", "ab " * 3000)] + [("en", "s1", "abé zz")] * 60
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    for top in (200, 3):
        got = divergence(docs, top=top).collect()
        assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute_force(rows, top=top)


def test_strange_tables(spark, tiny):
    rows = [(1, "en", "s", "x", "A a"), (2, "en", "s", "x", "a"), (3, "en", None, "x", "a"), (4, None, "s", "x", None)]
    docs = spark.createDataFrame(rows, "value int, lang string, source string, LANG2 string, text string").withColumnRenamed("LANG2", "part")
    got = divergence(docs).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute_force([(r[1], r[2], r[4]) for r in rows])
    assert divergence(docs.limit(0)).columns == COLUMNS and divergence(docs.limit(0)).count() == 0
