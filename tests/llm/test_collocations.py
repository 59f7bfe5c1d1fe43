import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import collocations, words
from orrery.llm.collocations import CLASSES, Shard, mine
from orrery.llm.words import Members, split_words

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute_force(rows, least, top, percent=80):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    many = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    found = {}
    for (lang, w), a in many.items():
        inside = (f[lang, x] for (other, x) in many if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x))))
        if any(100 * more >= percent * a for more in inside):
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, n[lang], -score)
        for lang, mine in found.items()
        for rank, (score, a, phrase, l, r) in enumerate(sorted(mine)[:top], 1)
    )


@pytest.fixture
def tiny(monkeypatch):
    """Many shards, windows, spans and batches, also for few texts."""
    for module, name, value in (
        (words, "SHARD_BYTES", 900), (words, "WINDOW_BYTES", 61), (collocations, "SPAN", 53), (collocations, "BATCH_ENTRIES", 7),
        (collocations, "ANDS_AT_ONCE", 11), (collocations, "SALTS", (3, 2)),
        (collocations, "HELD_SUMS", 50), (collocations, "PIECE_BYTES", 100), (collocations, "BUCKETS", (3, 5)),
    ):
        monkeypatch.setattr(module, name, value)


def text(rng):
    return "".join(rng.choice(["a", "B", "b", "cc", "é", " ", " ", "\t", "a b ", "of the ", ". ", ",", "\n", "z z z "]) for _ in range(rng.randrange(60)))


def test_words_are_split_as_the_patterns_say(monkeypatch):
    monkeypatch.setattr(words, "WINDOW_BYTES", 37)
    rng = random.Random(1)
    texts = [text(rng) for _ in range(200)] + [None, "", "...", "x" * 300 + " Y", "a.", "b"]
    got = split_words(pa.array(texts), CLASSES)
    want = []
    for i, t in enumerate(texts):
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            want += [(i, w, j == 0) for j, w in enumerate(re.findall("[^\x20\x09]+", piece))]
    names = [w.decode() for w in got.dictionary.to_pylist()]
    assert [(int(a), names[b], bool(c)) for a, b, c in zip(got.text, got.word, got.first, strict=True)] == want


def test_bitmaps_count_what_a_scan_counts(tiny):
    rng = np.random.default_rng(3)
    terms = rng.integers(0, 4, 700).astype(np.int32)
    first = rng.random(700) < 0.15
    first[0] = True
    keep = np.array([True, True, True, False])
    shard = Shard(pa.array(["x"]), pa.array([b"a", b"b", b"c", b"d"]), np.zeros(4, int), np.arange(4), terms, first)
    got = Counter()
    for columns, count in mine(shard, keep, None, 4):
        for *phrase, n in zip(*columns, count, strict=True):
            got[tuple(map(int, phrase))] += int(n)
    want = Counter()
    for size in (2, 3, 4):
        for i in range(len(terms) - size + 1):
            phrase = tuple(terms[i : i + size].tolist())
            if not first[i + 1 : i + size].any() and 3 not in phrase:
                want[phrase] += 1
    assert got == want


def test_filters_let_every_member_through():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    slots = np.zeros(1 << 4, np.uint64)
    held = Members(slots)
    for bit in (h & held.mask, (h >> np.uint64(32)) & held.mask):
        np.bitwise_or.at(slots, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
    assert held.has(h).all() and not Members(np.zeros(16, np.uint64)).has(h).any()


def test_results_equal_brute_force(spark, tiny):
    rng = random.Random(7)
    rows = [(rng.choice(["en", "en", "de", None, "und", ""]), text(rng)) for _ in range(300)]
    rows += [("en", "of the a b of the")] * 40 + [("fr", None), ("fr", ""), ("é", "q " * 3000), ("en", "a b c d e " * 200)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for least, top in ((5, 2000), (12, 6)):
        got = collocations.collocations(docs, least=least, top=top).collect()
        assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute_force(rows, least, top)


def test_strange_tables(spark, tiny):
    rows = [(1, "en", "x y", "a b", 2)] * 30 + [(2, None, None, None, None), (3, "en", "", "", 0)]
    docs = spark.createDataFrame(rows, "n int, lang string, PHRASE string, text string, a int").repartition(3)
    got = collocations.collocations(docs).collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [("en", 1, "a b", 30, 30, 30, 60, 1_000_000)]
    assert collocations.collocations(docs.limit(0)).columns == COLUMNS
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("n > 1")).count() == 0
