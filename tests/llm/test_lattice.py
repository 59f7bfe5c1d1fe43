import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import lattice


def test_decode_gives_the_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, (300, 8))
    point = lattice.decode(x)
    steps = lattice.shortest()
    assert steps.shape == (240, 8) and len(np.unique(steps, axis=0)) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    whole = np.rint(2 * point)
    assert ((whole % 2 == whole[:, :1] % 2).all(axis=1)).all() and (point.sum(axis=1) % 2 == 0).all()
    own = ((x - point) ** 2).sum(axis=1)
    around = ((x[:, None] - point[:, None] - steps) ** 2).sum(axis=2).min(axis=1)
    assert (own <= around + 1e-9).all() and own.max() <= 1 + 1e-9  # the covering radius is 1


def brute(rows):
    unit = {}
    for i, e in rows:
        x = np.array([np.nan if c is None else c for c in e] if e is not None else [], dtype=float)
        if len(x) and np.isfinite(x).all() and x.any():
            unit[i] = x / np.linalg.norm(x)
    links = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in unit}
    out = {}
    for i, _ in rows:
        seen, open_ = {i}, [i]
        while open_:
            for j in links.get(open_.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    open_.append(j)
        out[i] = (len(links.get(i, ())), min(seen), min(seen) == i)
    return out, sum(map(len, links.values())) // 2


def test_links_and_components(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 64))
    rows = []
    for i in range(500):
        centre = centres[i % 60]
        noise = rng.normal(size=64)
        rows.append((i, [float(c) for c in centre / np.linalg.norm(centre) + noise / np.linalg.norm(noise) * rng.choice([0.05, 0.15, 0.22, 0.6])]))
    rows += [(500 + i, rows[7][1]) for i in range(40)] + [(600, [2 * c for c in rows[7][1]])]
    rows += [(700, None), (701, [0.0] * 64), (702, [0.0] * 64), (703, [float("inf")] * 64), (704, [None, 1.0]), (705, []), (706, [1.0, 1.0]), (707, [1.0, 1.01])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, VEC_ID int, kept int").repartition(3)
    want, links = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(vectors).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in got)  # none below the threshold
    found = sum(g[0] for g in got.values()) / 2
    assert found >= 0.97 * links and sum(got[i] == want[i] for i in got) >= 0.9 * len(got)
    assert {i: got[i] for i in got if i >= 700} == {i: want[i] for i in want if i >= 700}
    assert lattice.near_vectors(vectors.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(str(tuple(r)) for r in lattice.near_vectors(vectors).collect())
    assert got == sorted(["(None, 0, None, True)", "(1, 2, 1, True)", "(1, 2, 1, True)", "(2, 2, 1, False)", "(3, 0, 3, True)"])


def near_copies(rng, centre, n, spread):
    noise = rng.normal(size=(n, len(centre)))
    return [[float(c) for c in v] for v in centre / np.linalg.norm(centre) + spread * noise / np.linalg.norm(noise, axis=1)[:, None]]


def test_groups_of_near_copies_are_counted_without_pairs(spark, monkeypatch):
    """Two groups, the centre of the second a link's angle from the first, and looser ones: all
    links are counted, and what the blocks hand on grows with the vectors only."""
    rng = np.random.default_rng(12)
    centre, aside = rng.normal(size=64), rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    aside -= (aside @ centre) * centre
    aside /= np.linalg.norm(aside)
    second = np.cos(0.3) * centre + np.sin(0.3) * aside
    vectors = near_copies(rng, centre, 300, 0.1) + near_copies(rng, second, 200, 0.1) + near_copies(rng, centre, 60, 0.25)
    vectors += near_copies(rng, rng.normal(size=64), 30, 0.15) + [[float(c) for c in rng.normal(size=64)] for _ in range(200)]
    order = rng.permutation(len(vectors)).tolist()
    rows = [(i, vectors[k]) for i, k in enumerate(order)] + [(2000 + i, vectors[0]) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want, links = brute(rows)
    for name, value in (("BLOCK_ROWS", 2048), ("BLOCK_ROWS", 64)):
        monkeypatch.setattr(lattice, name, value)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(frame).collect()}
        assert all(got[i][0] <= want[i][0] for i in got)
        assert sum(g[0] for g in got.values()) / 2 >= 0.99 * links
        assert sum(got[i][1:] == want[i][1:] for i in got) >= 0.98 * len(got)
    handed = []
    count = lattice.connected_components
    monkeypatch.setattr(lattice, "connected_components", lambda edges: handed.append(edges.count()) or count(edges))
    lattice.near_vectors(frame).count()
    assert links > 60_000 and handed[0] < 4 * len(rows)


def test_vectors_of_any_scale(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e200, 2.0001e200]), (3, [5e-324, 1e-323]), (4, [1.0, -1.0]), (5, [0.0, -0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(frame).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine just over the threshold, the hardest ones to meet."""
    rng = np.random.default_rng(21)
    rows = []
    for k in range(400):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        angle = np.arccos(0.9502)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (np.cos(angle) * a + np.sin(angle) * b).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in lattice.near_vectors(frame).collect()) / 2
    assert found >= 0.95 * 400


@pytest.mark.parametrize("plan", lattice.PLANS[1:5])
def test_finer_cells_keep_the_recall(plan):
    """Places depend on the cosine alone, so pairs tell the recall of tables of any size."""
    rng = np.random.default_rng(22)
    a, b = rng.normal(size=(2, 600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    both = np.stack([a, 0.9502 * a + np.sqrt(1 - 0.9502**2) * b], axis=1).reshape(1200, 64)
    stored, looked = cells_of(both, lattice.Plan(*plan[1:]))
    met = [bool(stored[2 * k] & looked[2 * k + 1] or stored[2 * k + 1] & looked[2 * k]) for k in range(600)]
    assert np.mean(met) >= 0.98


def cells_of(vectors, plan):
    n = len(vectors)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool))],
        names=["class", "code", "sketch", "ball"],
    )
    stored, looked = [set() for _ in range(n)], [set() for _ in range(n)]
    for made in lattice.cells(plan)([batch]):
        for key, i, is_stored in zip(*(made.column(k).to_pylist() for k in (0, 1, 4)), strict=True):
            (stored if is_stored else looked)[i].add(key)
    return stored, looked


def test_unrelated_vectors_meet_as_few_in_larger_tables():
    per_vector = {}
    for n in (2_000, 5_000, 20_000):
        vectors = np.random.default_rng(n).normal(size=(n, 64))
        keys, where = [[], []], [[], []]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n)), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool))],
            names=["class", "code", "sketch", "ball"],
        )
        for made in lattice.cells(lattice.plan_for(n))([batch]):
            stored = made.column(4).to_numpy(zero_copy_only=False)
            for side, at in enumerate((stored, ~stored)):
                keys[side].append(made.column(0).to_numpy()[at])
                where[side].append(made.column(1).to_numpy()[at])
        own, looked = (np.concatenate(k) for k in keys)
        own.sort()
        met = (np.searchsorted(own, looked, "right") - np.searchsorted(own, looked)).sum() - len(own)  # less each vector's own cells
        per_vector[n] = met / n
    assert max(per_vector.values()) <= 2 * per_vector[2_000], per_vector


def test_a_larger_table_is_linked_as_a_small_one(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(size=64)]) for i in range(400)]
    rows += [(1000 + k, near_copies(rng, np.array(rows[k][1]), 1, 0.2)[0]) for k in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, _ = brute(rows)
    monkeypatch.setattr(lattice, "PLANS", lattice.PLANS[2:])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(frame).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
