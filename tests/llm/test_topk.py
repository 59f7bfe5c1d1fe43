import numpy as np

from orrery.llm import topk


def brute(rows, every, k):
    code = {i: [int(np.floor(256 * float(x))) for x in e] for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = set()
    for q, e in code.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), i) for i, f in code.items() if i != q and len(f) == len(e))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


def test_equal_to_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.1, (20, 24))
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(0, 0.01 if i % 3 else 0.2, 24)]) for i in range(900)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (950, [0.0] * 24), (1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 24), (1050, [1e7] * 24), (1051, [1e5] * 24), (1100, [1.0, 2.0]), (1150, [])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, VECTOR int").repartition(4)
    want = brute(rows, 50, 5)
    for sample, step, block, queries, pairs in [(1024, 1024, 16384, 4096, 1 << 16), (16, 64, 300, 7, 50), (0, 64, 300, 7, 1000)]:
        for name, value in [("SAMPLE_ROWS", sample), ("STEP", step), ("ROW_BLOCK", block), ("QUERY_BLOCK", queries), ("PAIRS", pairs)]:
            monkeypatch.setattr(topk, name, value)
        assert {tuple(r) for r in topk.top_k(vectors).collect()} == want


def test_components_of_any_size(spark):
    """Codes beyond sums in 64 bits are multiplied and ranked as whole numbers; the score that is returned
    is held at the ends of 64 bits."""
    rows = [(0, [1e9, -1e9]), (1, [1e9, -1e9 + 1]), (2, [1e300, 1e300]), (3, [1e300, -1e300]), (4, [1.0, 1.0]), (5, [2.0, 1.0]), (50, [0.5, 0.25])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=6).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    most = topk.LONG
    assert got[0] == [(3, most), (1, most), (5, 256**2 * 10**9), (50, 256 * 64 * 10**9), (2, 0), (4, 0)]
    assert sorted(got[50], key=lambda x: (-x[1], x[0])) == got[50]
    assert dict(got[50])[1] == 128 * 256 * 10**9 + 64 * 256 * (1 - 10**9) and dict(got[50])[2] == most


def test_levels_prune_what_is_not_scored():
    """Random directions without clusters, the hardest input: each level leaves fewer pairs."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    code = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    ids, tally = np.arange(4000), {}
    top = topk.block_top(ids[:40], code[:40], np.full(40, -np.inf), ids, code, 5, tally)
    score = code[:40] @ code.T
    score[np.arange(40), np.arange(40)] = -(1 << 40)
    want = {(i, int(j), int(score[i, j])) for i in range(40) for j in np.lexsort((ids, -score[i]))[:5]}
    assert set(zip(*(c.tolist() for c in top), strict=True)) == want
    counts = list(tally.values())
    assert counts == sorted(counts, reverse=True) and tally["after 32"] < 0.6 * tally["pairs"]


def test_blocks_far_from_all_queries_are_passed_over():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 200, (12, 16))
    v = np.concatenate([c + rng.normal(0, 2, (topk.STEP, 16)) for c in centres]).round().astype(np.int64)
    tally = {}
    topk.block_top(np.arange(3), v[:3], np.full(3, -np.inf), np.arange(len(v)), v, 5, tally)
    assert tally["after 4"] < 0.2 * tally["pairs"]


def test_bounds_hold_at_every_resolution():
    rng = np.random.default_rng(0)
    q, v = rng.normal(0, 50, (40, 64)), rng.normal(3, 50, (60, 64))
    last = np.inf
    for n in (1, *topk.LEVELS):
        bound = topk.statistics(q, n) @ topk.statistics(v, n).T
        assert (bound >= q @ v.T - 1e-6).all() and bound.mean() <= last
        last = bound.mean()


def test_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).count() == 0
    two = spark.createDataFrame([(0, [0.5]), (None, [0.5]), (1, [-0.3])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(two).collect()] == [(0, 1, 1, 128 * -77)]


def test_ranks_beyond_64_bits_are_exact(spark):
    rows = [(0, [1e12, 0.0]), (1, [1e12, 5.0]), (2, [2e12, 1.0]), (3, [2e12, 2.0]), (4, [-1e12, 0.0]), (5, [-3e12, 0.0]), (6, [1e300, 1e300]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    code = {i: [int(x) * 256 if abs(x) >= 2**53 else int(x * 256 // 1) for x in v] for i, v in rows}
    score = {i: sum(a * b for a, b in zip(code[0], code[i], strict=True)) for i in code if i}
    want = sorted(score, key=lambda i: (-score[i], i))
    most = topk.LONG
    for blocks in (16_384, 2):
        topk.ROW_BLOCK, before = blocks, topk.ROW_BLOCK
        try:
            got = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(df, k=7).collect())
        finally:
            topk.ROW_BLOCK = before
        assert got == [(n, i, max(-most, min(most, score[i]))) for n, i in enumerate(want, 1)]
    numbers = [-(10**40), -(2**64), -(2**63), 2**63, 2**64, 10**40, 10**40 + 1]
    assert sorted(map(topk.sortable, numbers)) == list(map(topk.sortable, numbers)) and topk.sortable(2**63 - 1) == topk.sortable(-5) == ""
