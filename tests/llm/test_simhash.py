import itertools
import random

import numpy as np
import pytest
import xxhash

from orrery.llm import common, components, simhash
from orrery.llm.components import connected_components


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_trie_links_equal_brute_force():
    rng = np.random.default_rng(5)
    for bits, n in [(8, 60), (12, 90), (48, 120), (48, 2)] * 10:
        v = rng.integers(0, 1 << bits, max(1, n // 10), dtype=np.uint64)[rng.integers(0, max(1, n // 10), n)]
        for _ in range(4):
            v = v ^ (np.uint64(1) << rng.integers(0, bits, n).astype(np.uint64))
        g = np.sort(rng.integers(0, 3, n))
        order = np.lexsort((v, g))
        v, g = v[order], g[order]
        want = smallest_reachable(n, lambda i, j: g[i] == g[j] and int(v[i] ^ v[j]).bit_count() <= 3)
        assert simhash.trie_links(v, g, bits, 3).tolist() == want


def corpus():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "A\x0bB c", "É é x y", "word " * 20000]
    for _ in range(25):
        words = draw.choices(vocabulary, k=draw.randint(30, 200))
        texts.append(" ".join(words))
        for _ in range(draw.randint(0, 4)):
            near = list(words)
            near[draw.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    texts += [texts[12], texts[12]]
    return texts


def test_roots_hold_a_quarter_and_tries_the_rest(spark):
    rng = np.random.default_rng(9)
    for bits in (64, 48, 36):
        v = [int(x) for x in rng.integers(0, 1 << bits, 50, dtype=np.uint64)]
        rows = spark.createDataFrame([(i % 3, x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(v)], "root long, rest long, id long")
        quarter, found = bits // 4, set()
        for r in simhash.rooted(rows, bits).collect():
            k, own = divmod(r.root - r.id % 3 * (4 << quarter), 1 << quarter)
            low = bits - quarter * (k + 1)
            x = v[r.id]
            assert own == x >> low & (1 << quarter) - 1
            assert r.rest == (x >> low + quarter << low) | x & (1 << low) - 1
            found.add((r.id, k))
        assert len(found) == 200


def test_components_equal_brute_force(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame(
        [(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, DOC_ID string, fp int, component_id int"
    ).repartition(3)
    prints = [plain_fingerprint(t) for t in texts]
    want = smallest_reachable(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert len(set(want)) < len(set(prints))
    for small in ({"ROOT_ROWS": 3}, {"ROOT_ROWS": 3, "FEW_PARTS": 2, "PART_ROWS": 4}, {"MANY_ROWS": 9, "ROOT_ROWS": 3}, {"MANY_ROWS": 2, "ROOT_ROWS": 2, "BROADCAST_ROOTS": 0}, {}):
        for name, value in small.items():  # larger roots are dealt into parts, or taken apart
            monkeypatch.setattr(simhash, name, value)
        got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.simhash_groups(docs).collect()}
        assert got == {i: (prints[i], want[i]) for i in range(len(texts))}
        monkeypatch.undo()
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.collect()) == sorted(set(want))


def test_null_ids_repeated_ids_and_no_rows(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (1, "p q r s t"), (2, "p q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.simhash_groups(docs).collect())
    assert got == [("1", "1")] * 3 + [("2", "1")] + [("None", "None")] * 2
    assert sorted(str(r.doc_id) for r in simhash.drop_near_duplicates(docs).collect()) == ["1", "None", "None"]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_rows_of_a_common_key_are_joined_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 9 + [2] * 2 + [3] * 5 + [4])], "k long, i long")
    few = spark.createDataFrame([(1, "a", 9), (2, "b", 2), (3, "c", 5), (5, "e", 0)], "k long, v string, n long")
    want = sorted((r.k, r.i, r.v) for r in rows.join(few.drop("n"), "k").collect())
    for most in (100, 1):
        monkeypatch.setattr(common, "BROADCAST_KEYS", most)
        assert sorted((r.k, r.i, r.v) for r in common.join_counted(rows, few, "k").collect()) == want


@pytest.mark.parametrize("last", [0, 10, 500])
def test_connected_components_of_chains_stars_and_loops(spark, monkeypatch, last):
    monkeypatch.setattr(components, "LAST_EDGES", last)
    draw = random.Random(1)
    chain = list(range(100, 160))
    draw.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(7, k) for k in range(20, 40)] + [(5, 5), (None, 3), (9, 8), (8, 9)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {k: 100 for k in chain} | {k: 7 for k in [7, *range(20, 40)]} | {8: 8, 9: 8}
