"""Sharding by a hierarchical weighted hash tree (region, rack, shard)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, pick, table

#: Ranges of the hash of a row that get their slots by themselves; more spread the sort wider.
SLOT_BUCKETS = 1024
SLOTS_AT_ONCE = 10_000


@dataclass(frozen=True)
class Node:
    """A region, rack or (with a shard number) leaf. A parent weighs what its leaves weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def even_tree(shards: int = 16, regions: int = 2, racks: int = 2) -> Node:
    """shards leaves of weight 1, dealt in turn over regions x racks; empty racks are left out."""
    held: dict[tuple[int, int], list[int]] = {}
    for k in range(shards):
        held.setdefault((k % regions, k // regions % racks), []).append(k)
    made = []
    for r in range(regions):
        found = [
            Node(f"rack{r}.{c}", tuple(Node(f"shard{k}", shard=k) for k in held[r, c]))
            for c in range(racks)
            if (r, c) in held
        ]
        if found:
            made.append(Node(f"region{r}", tuple(found)))
    return Node("root", tuple(made))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """tree with one more shard, in a region of its own: no other subtree's weight changes, so
    rows move only into the new leaf."""
    leaf = Node(f"shard{shard}", shard=shard, own_weight=weight)
    return Node(tree.name, (*tree.children, Node(f"region+{shard}", (Node(f"rack+{shard}", (leaf,)),))))


def hashed(*parts: Column) -> Column:
    """The first 52 bits of the md5 of parts, joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1), the same on every run and in other engines."""
    return (hashed(*parts) + 0.5) / F.lit(float(1 << 52))


def place(node: Node, *key: Column) -> Column:
    """The shard that key (not null) descends to. At every level each child draws -ln(u)/weight from the
    hash of (key, child) and the least wins: a child is taken with probability weight/total, and
    a change of its weight moves keys only into it or out of it."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(node.children[0], *key)
    draws = [
        F.struct((-F.log(uniform(*key, F.lit(c.name))) / F.lit(c.weight)).alias("d"), F.lit(i).alias("i"))
        for i, c in enumerate(node.children)
    ]
    best = F.array_min(F.array(*draws))["i"]
    out = place(node.children[-1], *key)
    chosen = None
    for i, c in enumerate(node.children[:-1]):
        branch = place(c, *key)
        chosen = F.when(best == i, branch) if chosen is None else chosen.when(best == i, branch)
    return chosen.otherwise(out)


def assign_shards(
    docs: DataFrame,
    tree: Node,
    bigger: Node | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    slot_buckets: int = SLOT_BUCKETS,
) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard and slot of every row.

    Only the id and the trees decide on the shard, so rows with equal ids (a null id is one such
    id) share it. size is the text's UTF-8 bytes plus 1; a null text counts as no bytes, its
    crc32 as that of the empty text. Slots number the rows of each shard from 0 without gaps:
    rows are split by hash into slot_buckets ranges per shard, ranges are counted, and a row's
    slot is the rows in earlier ranges plus its place in its own; no task sorts a whole shard.
    Repeated rows are counted map-side, sorted as one and given a slot each in the end. An empty
    table gives no rows; extra columns are ignored.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    more = place(bigger, key) if bigger is not None else F.lit(None)
    base = base.select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), key.alias("key"),
        place(tree, key).cast("int").alias("shard"), more.cast("int").alias("grown_shard"),
    )
    bucket = (hashed(F.col("key"), F.col("text_crc32"), F.col("size")) % slot_buckets).cast("int")
    alike = base.withColumn("bucket", bucket).groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard", "bucket")
    alike = cut(alike.agg(F.count("*").alias("n")))
    counts = alike.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("place", F.coalesce(F.sum("n").over(within), F.lit(0)))
    # starts has one row for each shard and range at most: shards x slot_buckets, both parameters
    placed = placed.join(F.broadcast(starts), ["shard", "bucket"]).withColumn("first", F.col("start") + F.col("place"))
    # a slot for each of n equal rows, SLOTS_AT_ONCE at a time
    placed = placed.withColumn("end", F.col("first") + F.col("n") - 1)
    placed = placed.withColumn("some", F.explode(F.sequence("first", "end", F.lit(SLOTS_AT_ONCE).cast("long"))))
    slot = F.explode(F.sequence("some", F.least(F.col("some") + (SLOTS_AT_ONCE - 1), "end"))).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", slot, "grown_shard").select(
        "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )


def op9_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(16)
    placed = assign_shards(table(spark, sf_dir, "documents"), tree, grown(tree, 16))
    law = F.lit("key").cast(T.StringType()).alias("law")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", "grown_shard")
