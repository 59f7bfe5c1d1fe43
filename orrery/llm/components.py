"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut

MAX_ROUNDS = 200
#: So few edges are left to one task; by rounds they would take several more of a job each.
LAST_EDGES = 500


def _finish(batches):
    """node, to: each node of a few edges and the least node that it reaches."""
    least: dict[int, int] = {}

    def top(node: int) -> int:
        while least.setdefault(node, node) != node:
            least[node] = node = least[least[node]]
        return node

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            least[max(a, b)] = min(a, b)
    nodes = np.array(sorted(least), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([top(n) for n in nodes.tolist()], pa.int64())], names=["node", "to"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node reachable.

    Every round each node hooks onto the closed neighbour whose hash, salted by the round, is
    least, and the edges are contracted along the hooks; expected rounds are logarithmic in the
    number of nodes, whatever the shape of the graph (stars take one, chains no more than random
    graphs do). Only per-node minima, combined map-side, and joins on the node are used, so a hub
    with a great share of the edges is split by the adaptive skew join and nothing is gathered in
    one task or on the driver. Null ends and loops link nothing.
    """
    edge = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edge = cut(edge.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    hooks = []
    for salt in range(MAX_ROUNDS):
        left = edge.count()
        if left <= LAST_EDGES:
            if left:
                hooks.append(cut(arrow_map(edge.repartition(1), _finish, "node long, to long")))
            break
        both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def ranked(c, salt=salt):
            return F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("n"))

        hook = both.groupBy("a").agg(F.min(ranked("b")).alias("best"))
        hook = cut(hook.select(F.col("a").alias("node"), F.least("best", ranked("a"))["n"].alias("to")))
        hooks.append(hook)
        edge = (
            edge.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
            .distinct()
        )
        edge = cut(edge)
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    if not hooks:
        return edge.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = hooks[-1].select("node", F.col("to").alias("root"))
    for hook in reversed(hooks[:-1]):
        later = found.select(F.col("node").alias("to"), "root")
        found = hook.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    if len(hooks) > 1:
        found = cut(found)
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")
