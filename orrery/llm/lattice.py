"""Embedding near-duplicates by E8 lattice hashing with probes of neighbouring cells."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cut, join_counted, pick, sound_vectors, table
from .components import connected_components

COSINE = 0.95
#: For tables of up to so many different vectors: blocks of 8 dimensions that a cell is made of, each an E8
#: point; the scale of the lattice; cells looked into, the own one among them; and tables of random
#: projections. Cells get finer as the table grows, so that a vector meets about as many unrelated ones
#: (4 at most, on average) whatever its size. A pair's places depend on its cosine alone, as the
#: projections are normal. At the threshold two vectors meet in one table with probability 0.66, 0.78, 0.64,
#: 0.46, 0.41, 0.27 and 0.14 (measured), in any with 0.99 and more; closer pairs with more.
PLANS = (
    (2_500, 1, 1.0, 9, 6), (30_000, 2, 1.6, 32, 5), (220_000, 2, 1.4, 32, 6), (1_600_000, 2, 1.2, 32, 9),
    (20_000_000, 3, 1.6, 32, 10), (300_000_000, 3, 1.4, 32, 16), (1 << 62, 3, 1.2, 32, 33),
)
#: Lattice points next to a block's own that are looked at.
NEAR = 8
#: Pairs that met are held against sketches of 64 projections' signs before their vectors are
#: fetched. At the threshold 6.5 bits differ on average, with deviation 2.4; unrelated: 32, 4.
SKETCH_BITS = 18
VECTORS_AT_A_TIME = 512
#: Vectors in one cell are gathered into a ball around one of them: those within half the
#: threshold's angle of it, any two of which are within the whole angle. So many rounds, each with
#: the cells of another table; cells with fewer vectors are left as they are. A ball's sketch may
#: be so many bits further from another's than a vector's.
ROUNDS, LEAST_BALL, BALL_BITS = 3, 8, 6
ANGLE = float(np.arccos(COSINE))
HALF = ANGLE / 2 - 1e-6
#: Members of a ball, and of those that it is held against, in one task at most; smaller groups are
#: dealt into up to FEW_BLOCKS blocks of at least LEAST_BLOCK rows.
BLOCK_ROWS, FEW_BLOCKS, LEAST_BLOCK = 2_048, 16, 64
#: Shares into which rows of a ball are dealt for joins on it.
SALTS = 16


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum (the lattice D8)."""
    point = np.rint(x)
    error = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(error[odd]).argmax(axis=1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: D8, or D8 moved by a half in every coordinate."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def shortest() -> np.ndarray:
    """The 240 steps from a lattice point to its nearest others."""
    pairs = np.zeros((112, 8))
    steps = itertools.product(itertools.combinations(range(8), 2), (1, -1), (1, -1))
    for k, ((i, j), a, b) in enumerate(steps):
        pairs[k, i], pairs[k, j] = a, b
    halves = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.concatenate([pairs, np.array(halves)])


def sound(batches):
    """vec_id and the components as doubles; null where a vector can have no cosine."""
    for batch in batches:
        codes = [x if x is not None and x.strip(b"\0") else None for x in sound_vectors(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], names=["vec_id", "code"])


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1, whatever their scale."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_length(codes: list[bytes]):
    """The positions of the codes of each length, so many at a time, with their vectors."""
    size = np.array([len(c) for c in codes])
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        for k in range(0, len(at), VECTORS_AT_A_TIME):
            part = at[k : k + VECTORS_AT_A_TIME]
            yield part, np.frombuffer(b"".join(codes[i] for i in part)).reshape(len(part), -1)


@dataclass(frozen=True)
class Plan:
    blocks: int
    scale: float
    probes: int
    tables: int


def plan_for(vectors: int) -> Plan:
    return next(Plan(*rest) for most, *rest in PLANS if vectors <= most)


def _tables(dim: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Projections of the tables, and salts of the cells' keys."""
    rng = np.random.default_rng([8240, dim])
    width = 8 * plan.blocks
    return rng.normal(size=(plan.tables, dim, width)), rng.integers(1, 1 << 63, (plan.tables, width + 1), dtype=np.uint64)


def probed(y: np.ndarray, plan: Plan, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each place, and the cells to look into: of all that are made of each block's own point or
    one of the NEAR next to it, those nearest to the place, the own one first."""
    rows = np.arange(len(y))[:, None]
    points = np.zeros((len(y), 1, 0))
    far = np.zeros((len(y), 1))
    for k in range(plan.blocks):
        z = y[:, 8 * k : 8 * k + 8]
        own = decode(z)
        around = ((z[:, None, :] - own[:, None, :] - steps) ** 2).sum(axis=2)
        near = np.argpartition(around, NEAR, axis=1)[:, :NEAR]
        here = np.concatenate([own[:, None, :], own[:, None, :] + steps[near]], axis=1)
        away = np.concatenate([((z - own) ** 2).sum(axis=1)[:, None], around[rows, near]], axis=1)
        total = (far[:, :, None] + away[:, None, :]).reshape(len(y), -1)
        best = np.argsort(total, axis=1, kind="stable")[:, : plan.probes]
        i, j = np.divmod(best, away.shape[1])
        points, far = np.concatenate([points[rows, i], here[rows, j]], axis=2), total[rows, best]
    own = np.concatenate([decode(y[:, 8 * k : 8 * k + 8]) for k in range(plan.blocks)], axis=1)
    return own, points


def _sketch_directions(dim: int) -> np.ndarray:
    return np.random.default_rng([6464, dim]).normal(size=(dim, 64))


def _sketches(direction: np.ndarray) -> np.ndarray:
    return np.packbits(direction @ _sketch_directions(direction.shape[1]) > 0, axis=1).view(">i8").astype(np.int64)[:, 0]


def _key(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A hash of lattice points (last axis) in a table."""
    whole = np.rint(2 * points).astype(np.int64).view(np.uint64)
    key = (whole * (salt[:-1] | np.uint64(1))).sum(axis=-1, dtype=np.uint64) ^ salt[-1]
    return (key * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


#: The cells in which balls are looked for: those of one block.
ROUND_PLAN = Plan(1, 1.0, 1, ROUNDS)


def own_cells(batches):
    """key, id, sketch, level: the cell of each vector in each of the first tables."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for part, x in by_length(batch.column(1).to_pylist()):
            direction = unit(x)
            sketch, (projections, salts) = _sketches(direction), _tables(x.shape[1], ROUND_PLAN)
            for level in range(ROUNDS):
                key = _key(decode(direction @ projections[level] / ROUND_PLAN.scale), salts[level])
                columns = [pa.array(c) for c in (key, ids[part], sketch, np.full(len(part), level, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "sketch", "level"])


def cells(plan: Plan):
    """key, class, sketch, ball, stored: the cell of each vector in each table (stored), and the cells
    in which it looks for others. A ball's members have its sketch."""

    def run(batches):
        steps = shortest()
        for batch in batches:
            ids, ball = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            given = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            for part, x in by_length(batch.column(1).to_pylist()):
                direction = unit(x)
                sketch = np.where(ball[part], given[part], _sketches(direction))
                for projection, salt in zip(*_tables(x.shape[1], plan), strict=True):
                    own, around = probed(direction @ projection / plan.scale, plan, steps)
                    key = np.concatenate([_key(own, salt)[:, None], _key(around, salt)], axis=1)
                    stored = np.zeros(key.shape, bool)
                    stored[:, 0] = True
                    columns = [key.ravel(), *(np.repeat(c, key.shape[1]) for c in (ids[part], sketch, ball[part])), stored.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "class", "sketch", "ball", "stored"])

    return run


def cosines(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The cosine of each pair of vectors, in double precision; -2 if their lengths differ."""
    out = np.full(len(left), -2.0)
    same = [i for i, (x, y) in enumerate(zip(left, right, strict=True)) if len(x) == len(y)]
    for part, x in by_length([left[i] for i in same]):
        at = [same[i] for i in part]
        y = np.frombuffer(b"".join(right[i] for i in at)).reshape(len(at), -1)
        out[at] = np.einsum("ij,ij->i", unit(x), unit(y))
    return out


def within(batches):
    """id, lead, sketch of the members within HALF of the vector that leads their cell."""
    for batch in batches:
        near = cosines(batch.column("code").to_pylist(), batch.column("lead_code").to_pylist()) >= np.cos(HALF)
        yield batch.select(["id", "lead", "sketch"]).filter(pa.array(near))


def close_classes(batches):
    """a, b, ball_a, ball_b of the pairs of classes that may hold a link: two vectors, if their
    cosine is COSINE or more; if either is a ball, if its vector is near enough for a member."""
    for batch in batches:
        balls = sum(batch.column(k).to_numpy(zero_copy_only=False).astype(int) for k in ("ball_a", "ball_b"))
        bar = np.where(balls == 0, COSINE, np.cos(ANGLE + balls * HALF + 1e-9))
        near = cosines(batch.column("code_a").to_pylist(), batch.column("code_b").to_pylist()) >= bar
        yield batch.select(["a", "b", "ball_a", "ball_b"]).filter(pa.array(near))


def count_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """id, others, owner, partner: of the members of a ball (left) and vectors of other classes
    (right) those that link, the rows that each links with on the other side, and between which
    classes (partner: once for each vector on the right)."""
    names = ["id", "others", "owner", "partner"]
    found = [pa.table([pa.array([], pa.int64())] * 4, names=names)]
    codes_l, codes_r = left.column("code").to_pylist(), right.column("code").to_pylist()
    for at_l, x in by_length(codes_l):
        for at_r, y in by_length(codes_r):
            if x.shape[1] != y.shape[1]:
                continue
            near = unit(x) @ unit(y).T >= COSINE
            for table_, at, hits, other, at_other in ((left, at_l, near, right, at_r), (right, at_r, near.T, left, at_l)):
                on = np.flatnonzero(hits.any(axis=1))
                others = hits[on] @ other.column("n").to_numpy()[at_other]
                ids, owner = (table_.column(k).to_numpy()[at[on]] for k in ("id", "owner"))
                partner = pa.array(right.column("class").to_numpy()[at[on]] if table_ is right else [None] * len(on), pa.int64())
                found.append(pa.table([pa.array(ids), pa.array(others), pa.array(owner), partner], names=names))
    return pa.concat_tables(found)


def _salted(rows: DataFrame, few: DataFrame, *key: str) -> DataFrame:
    """rows joined to few, which has one row a key, with the rows of a common key spread over
    several tasks. rows have id."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(few, [*key, "salt"]).drop("salt")


def gathered(classes: DataFrame) -> DataFrame | None:
    """id, lead, sketch: the vectors that lie in a ball, the one it is around (the least id of its
    cell, a member too) and that one's sketch. None if there is no ball."""
    placed = cut(arrow_map(classes.select("id", "code"), own_cells, "key long, id long, sketch long, level int"))
    crowded = placed.groupBy("level", "key").count().where(F.col("count") >= LEAST_BALL)
    crowded = cut(_salted(placed, crowded.select("level", "key"), "level", "key"))
    found = None
    for level in sorted(r.level for r in crowded.select("level").distinct().collect()):  # ROUNDS numbers at most
        free = crowded.where(F.col("level") == level).select("key", "id", "sketch")
        if found is not None:
            free = free.join(found.select("id"), "id", "left_anti")
        leads = free.groupBy("key").agg(F.min(F.struct("id", "sketch")).alias("first"), F.count("*").alias("members"))
        leads = cut(leads.where(F.col("members") >= LEAST_BALL).select("key", "first.*"))
        if leads.isEmpty():
            continue
        lead_codes = leads.join(classes.select("id", F.col("code").alias("lead_code")), "id")
        members = _salted(free.select("key", "id"), lead_codes.select("key", F.col("id").alias("lead"), "sketch", "lead_code"), "key")
        members = members.join(classes.select("id", "code"), "id").select("id", "lead", "sketch", "code", "lead_code")
        more = arrow_map(members, within, "id long, lead long, sketch long")
        found = cut(more if found is None else found.unionByName(more))
    return found


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Equal vectors are one class and cost no pairs. Vectors within half the threshold's angle of
    one vector of their cell are gathered around it into a ball: any two of them link, so a group
    of near copies, whatever its size, is counted and not paired. Classes (balls and single
    vectors) meet in the lattice cells of their members in a join on the cell, pass the sketch test
    inside that join, and their cosine is verified. Two single vectors link by that. Of a ball that
    comes near enough to another class the members are held against that class's in blocks, which
    give the number of links of each vector, not the links. Components are found among classes.

    Vectors that are null, zero, empty or hold null or non-finite components link with nothing, nor
    do rows without an id, whose component is null. Rows that share an id are counted apart and
    share their vectors' links. Vectors of different lengths don't link. An empty table gives no
    rows; extra columns are ignored.
    """
    base = pick(vectors, vec_id=id_col, embedding=vector_col).selectExpr("cast(vec_id as long) vec_id", "embedding")
    base = cut(arrow_map(base, sound, "vec_id long, code binary"))
    able = base.where("code IS NOT NULL AND vec_id IS NOT NULL")
    classes = cut(able.groupBy("code").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    plan = plan_for(classes.count())
    balls = gathered(classes)
    if balls is None:
        named = classes.select("code", "id", "n", F.col("id").alias("class"), F.lit(None).cast("long").alias("sketch"), F.lit(False).alias("ball"))
    else:
        named = classes.join(balls, "id", "left")
        named = cut(named.select("code", "id", "n", F.coalesce("lead", "id").alias("class"), "sketch", F.col("lead").isNotNull().alias("ball")))

    def placed_in_cells(some: DataFrame) -> DataFrame:
        return arrow_map(some.select("class", "code", "sketch", "ball"), cells(plan), "key long, class long, sketch long, ball boolean, stored boolean")

    placed = placed_in_cells(named.where("NOT ball"))
    if balls is not None:  # whose members are in few cells
        placed = placed.unionByName(placed_in_cells(named.where("ball")).distinct())
    placed = cut(placed)
    one = placed.where("stored").select("key", F.col("class").alias("x"), F.col("sketch").alias("s"), F.col("ball").alias("u"))
    other = placed.where("NOT stored").select("key", F.col("class").alias("y"), F.col("sketch").alias("t"), F.col("ball").alias("v"))
    bits = F.bit_count(F.col("s").bitwiseXOR(F.col("t"))) - BALL_BITS * (F.col("u").cast("int") + F.col("v").cast("int"))
    met = one.join(other, (one["key"] == other["key"]) & (F.col("x") != F.col("y")) & (bits <= SKETCH_BITS))
    first = F.col("x") < F.col("y")
    met = met.select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
        F.when(first, F.col("u")).otherwise(F.col("v")).alias("ball_a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("ball_b"),
    ).distinct()
    for side in "ab":
        met = met.join(classes.select(F.col("id").alias(side), F.col("code").alias(f"code_{side}")), side)
    close = cut(arrow_map(met, close_classes, "a long, b long, ball_a boolean, ball_b boolean"))

    links = close.where("NOT ball_a AND NOT ball_b").select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(classes.select(F.col("id").alias("b"), "n"), "b").select(F.col("a").alias("id"), F.col("n").alias("others"))
    near = close.where("ball_a OR ball_b")
    edges = links
    if balls is not None:
        owner_is_a = F.col("ball_a") & (~F.col("ball_b") | (F.col("a") < F.col("b")))
        near = near.select(F.when(owner_is_a, F.col("a")).otherwise(F.col("b")).alias("owner"), F.when(owner_is_a, F.col("b")).otherwise(F.col("a")).alias("class"))
        members = named.select("id", "n", "code", "class")
        left = members.join(near.select(F.col("owner").alias("class")).distinct(), "class").withColumn("owner", F.col("class"))
        right = near.join(members, "class")
        rows = F.count("*")
        per_block = F.greatest(F.ceil(rows / BLOCK_ROWS), F.least(F.lit(FEW_BLOCKS), F.ceil(rows / LEAST_BLOCK))).cast("int")
        sizes = left.groupBy("owner").agg(per_block.alias("l_blocks")).join(right.groupBy("owner").agg(per_block.alias("r_blocks")), "owner")
        left, right = (_salted(rows, sizes, "owner") for rows in (left, right))

        def own_block(blocks: str) -> Column:
            return F.pmod(F.xxhash64("id", F.lit(7)), F.col(blocks)).cast("int")

        def all_blocks(blocks: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

        left = left.withColumn("i", own_block("l_blocks")).withColumn("j", all_blocks("r_blocks"))
        right = right.withColumn("j", own_block("r_blocks")).withColumn("i", all_blocks("l_blocks"))
        kept = ["owner", "i", "j", "id", "n", "code", "class"]
        left, right = (rows.select(kept).toDF(*kept) for rows in (left, right))
        crossing = left.groupBy("owner", "i", "j").cogroup(right.groupBy("owner", "i", "j"))
        crossing = cut(crossing.applyInArrow(count_links, "id long, others long, owner long, partner long"))
        counted = counted.unionByName(crossing.select("id", "others"))
        between = crossing.where("partner IS NOT NULL").select(F.col("owner").alias("a"), F.col("partner").alias("b")).distinct()
        edges = links.unionByName(between)
    counted = counted.groupBy("id").agg(F.sum("others").alias("others"))
    component = connected_components(edges).select(F.col("node").alias("class"), "component")
    totals = named.groupBy("class").agg(F.sum("n").alias("rows"), F.min("id").alias("least"))
    totals = totals.join(component, "class", "left")
    known = _salted(named, totals, "class").join(counted, "id", "left").select(
        "code",
        "n",
        (F.when(F.col("ball"), F.col("rows")).otherwise(F.col("n")) - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "least").alias("component_id"),
    )
    out = join_counted(able, cut(known), "code").select("vec_id", "n_links", "component_id")
    unable = base.where("code IS NULL OR vec_id IS NULL").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = out.unionByName(unable)
    component_id = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"),
    )


def op1_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
