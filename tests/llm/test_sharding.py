import hashlib
import math
import zlib

from pyspark.sql import functions as F

from orrery.llm import sharding
from orrery.llm.sharding import Node, assign_shards, even_tree, grown, place


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def descend(node, key):
    """The tree's law, draw by draw."""
    while node.shard is None:
        node = min(node.children, key=lambda c: -math.log((number(key, c.name) + 0.5) / 2**52) / c.weight)
    return node.shard


def test_every_row_is_where_the_draws_put_it(spark, monkeypatch):
    texts = ["", "é", "x y", None]
    rows = [(i % 701, texts[i % 4] and texts[i % 4] + "z" * (i % 9)) for i in range(1500)] + [(None, "n")] * 3 + [(5000, "many")] * 70
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tree = even_tree(11, 3, 2)
    bigger = grown(tree, 11, 2.5)
    want = {}
    for doc_id, text in rows:
        key, raw = "null" if doc_id is None else str(doc_id), (text or "").encode()
        crc, size = zlib.crc32(raw), len(raw) + 1
        place_ = (number(key, crc, size) % 16, -1 if doc_id is None else doc_id, crc, size)
        want.setdefault(descend(tree, key), []).append((*place_, doc_id, descend(bigger, key)))
    want = sorted(str((r[4], r[3], r[2], shard, slot, r[5])) for shard, mine in want.items() for slot, r in enumerate(sorted(mine, key=lambda r: r[:4])))
    for at_once in (10_000, 7):
        monkeypatch.setattr(sharding, "SLOTS_AT_ONCE", at_once)
        assert sorted(str(tuple(r)) for r in assign_shards(docs, tree, bigger, slot_buckets=16).collect()) == want


def test_slots_are_gapless_and_growth_moves_rows_only_into_the_new_shard(spark):
    docs = spark.createDataFrame([(i, f"text {i % 300}") for i in range(4000)], "doc_id long, text string").repartition(5)
    tree = even_tree(16)
    got = assign_shards(docs, tree, grown(tree, 16), slot_buckets=8).collect()
    assert len(got) == 4000
    for k in range(16):
        mine = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in mine) == list(range(len(mine))) and 150 < len(mine) < 350
    assert {r.grown_shard for r in got if r.grown_shard != r.shard} == {16}
    assert 150 < sum(r.grown_shard == 16 for r in got) < 330
    assert all(r.text_crc32 == zlib.crc32(f"text {r.doc_id % 300}".encode()) for r in got)
    again = assign_shards(docs.repartition(2), tree, slot_buckets=8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_a_weight_moves_rows_only_in_its_subtree(spark):
    def tree(w):
        left = Node("l", (Node("l0", shard=0), Node("l1", shard=1)))
        right = Node("r", (Node("r0", shard=2, own_weight=w), Node("r1", shard=3)))
        return Node("root", (left, right))

    keys = spark.range(6000).withColumn("a", place(tree(1.0), F.col("id"))).withColumn("b", place(tree(3.0), F.col("id")))
    moved = {(r.a, r.b) for r in keys.where("a <> b").collect()}
    # out of the other region into the heavier one, or to the heavier leaf: never back
    assert moved <= {(0, 2), (0, 3), (1, 2), (1, 3), (3, 2)} and (3, 2) in moved


def test_strange_rows(spark):
    rows = [(None, None), (None, ""), (1, "é" * 100_000), (1, "é" * 100_000), (2, "x")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, SIZE int")
    got = assign_shards(docs, even_tree(4), slot_buckets=2).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == [("1", 200_001)] * 2 + [("2", 2), ("None", 1), ("None", 1)]
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert assign_shards(docs.limit(0), even_tree(4)).count() == 0
