"""Exact top-k by multi-resolution segment statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, bounded_batches, least_by_hash, pick, sound_vectors, table

K = 5
SCALE = 256
#: Segments of a vector at each resolution, coarse to fine.
LEVELS = (4, 16, 32)
#: Rows and queries of one task of the grid; a block of either is some MB whatever the table.
ROW_BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Rows held against the queries at a time, and pairs scored at a time.
STEP, PAIRS = 1_024, 1 << 16
#: A sample of so many rows, the same for all tasks, gives each query a score that its k-th best
#: is not below.
SAMPLE_ROWS = 1_024
LONG = (1 << 63) - 1


def sound(batches):
    """vec_id, dim, values (doubles) of the vectors that take part."""
    for batch in batches:
        both = zip(batch.column(0).to_pylist(), sound_vectors(batch.column(1)), strict=True)
        kept = [(i, len(x) // 8, x) for i, x in both if i is not None and x is not None]
        if kept:
            columns = [pa.array(c, t) for c, t in zip(zip(*kept, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "vector"])


def codes(vectors: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of so many vectors, and which of them are small enough for sums in 64
    bits; the others' codes are 0 there, as exact_codes() has them."""
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), dim)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * x)
    small = (np.abs(scaled) < np.sqrt(2.0**62 / max(1, dim))).all(axis=1)
    return np.where(small[:, None], scaled, 0).astype(np.int64), small


def exact_codes(vector: bytes) -> list[int]:
    """floor(SCALE * x) of a vector of any size: a large double is a whole number itself."""
    return [int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(SCALE * x)) for x in np.frombuffer(vector).tolist()]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Vectors whose inner product is at least that of the given ones: per segment of m components
    sqrt(m) * mean and sqrt(m) * deviation. (The components less their means are orthogonal to the
    means, and by Cauchy and Schwarz their product is at most that of the deviations. In terms of
    distances: |q|^2 + |v|^2 less twice it bounds the squared distance from below.)"""
    out = []
    for p in np.array_split(np.arange(x.shape[1]), segments):
        part = x[:, p]
        mean = part.mean(axis=1)
        out += [mean * np.sqrt(len(p)), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1)


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], score[keep]


def block_top(
    query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, tally: dict[str, int] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, id, score) of the k best rows of a block for every query of a block;
    rows below least, which a query's k-th best is not, may be left out.

    Rows with like coarse statistics are taken together, and a query passes over all of them if
    even the bound from their ranges is too low. For the others the bounds are taken coarse to
    fine; only pairs whose bounds at all resolutions reach the k-th best score so far are scored,
    exactly, and it rises as they are. tally, if given, counts the pairs that each level leaves."""
    dim, least = q.shape[1], least.copy()
    levels = [n for n in LEVELS if n < dim]
    of_q, of_v = ([statistics(x.astype(np.float64), n) for n in levels] for x in (q, v))
    # room for rounding in sums of products of this size; scores are whole numbers
    room = 1e-10 * np.linalg.norm(q.astype(np.float64), axis=1) * np.linalg.norm(v.astype(np.float64), axis=1).max(initial=0) + 0.5
    order = np.lexsort(of_v[0].T) if levels else np.arange(len(ids))
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    steps = [order[start : start + STEP] for start in range(0, len(order), STEP)]
    reach = np.full((len(steps), len(q)), np.inf)
    for i, rows in enumerate(steps if levels else ()):
        low, high = of_v[0][rows].min(axis=0), of_v[0][rows].max(axis=0)
        reach[i] = np.maximum(of_q[0] * low, of_q[0] * high).sum(axis=1)
    for i in np.argsort(-reach.mean(axis=1), kind="stable").tolist():  # near ones first, as they raise the k-th best
        rows, asked = steps[i], np.flatnonzero(reach[i] >= least - room)
        alive = query_ids[asked][:, None] != ids[rows][None, :]
        if tally is not None:
            tally["pairs"] = tally.get("pairs", 0) + len(q) * len(rows)
        for n, in_q, in_v in zip(levels, of_q, of_v, strict=True):
            a, b = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            bound = in_q[asked[a]] @ in_v[rows[b]].T
            alive[np.ix_(a, b)] &= bound >= (least - room)[asked[a]][:, None]
            if tally is not None:
                tally[f"after {n}"] = tally.get(f"after {n}", 0) + int(alive.sum())
        a, b = np.nonzero(alive)
        a, b = asked[a], rows[b]
        found = [best]
        for c in range(0, len(a), PAIRS):
            x, y = a[c : c + PAIRS], b[c : c + PAIRS]
            score = np.einsum("ij,ij->i", q[x], v[y])
            good = score >= least[x]
            found.append((x[good], ids[y[good]], score[good]))
        best = best_of(*(np.concatenate(f) for f in zip(*found, strict=True)), k)
        full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) >= k)
        if len(full):
            lowest = np.searchsorted(best[0], full, side="right") - 1
            least[full] = np.maximum(least[full], best[2][lowest])
    return best


def sortable(score: int) -> str:
    """Text that sorts as a whole number beyond 64 bits does; empty for those within."""
    if -LONG <= score <= LONG:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"1{len(digits):06d}{digits}"
    return f"0{999_999 - len(digits):06d}{digits.translate(_TURNED)}"


_TURNED = str.maketrans("0123456789", "9876543210")


def large_top(query_ids: np.ndarray, q: list[bytes], ids: np.ndarray, v: list[bytes], which: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(number of the query, id, score) as block_top(), for the pairs in which either is too large for
    sums in 64 bits (which: by query and row), in whole numbers of any size."""
    exact_q, exact_v = {}, {}
    best: dict[int, list[tuple[int, int]]] = {}
    for i, j in np.argwhere(which & (query_ids[:, None] != ids[None, :])).tolist():
        for held, all_, at in ((exact_q, q, i), (exact_v, v, j)):
            if at not in held:
                held[at] = exact_codes(all_[at])
        total = sum(a * b for a, b in zip(exact_q[i], exact_v[j], strict=True))
        mine = best.setdefault(i, [])
        mine.append((-total, int(ids[j])))
        if len(mine) > 2 * k:
            best[i] = sorted(mine)[:k]
    return [(i, row, -total) for i, mine in best.items() for total, row in sorted(mine)[:k]]


def top_k(vectors: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query (ids
    divisible by every) with all other rows, ties to the smaller id.

    Rows and queries are dealt by hash into blocks of bounded size, and each pair of blocks is a
    task of its own: a query block meets every row, and no block grows with the table. Each query
    brings along the k-th best score of a sample of rows, so that all tasks prune from the start.
    Vectors that are null, hold null or non-finite components, or have no id take no part; vectors
    of another length than the query's are no candidates. Scores beyond 64 bits are ranked as the whole
    numbers that they are, and returned as the nearest that 64 bits hold. Repeated ids: rows with the query's own id are not its candidates. An empty table gives
    no rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    base = arrow_map(pick(vectors, v=id_col, e=vector_col).selectExpr("cast(v as long) v", "e"), sound, "vec_id long, dim int, vector binary")
    n = vectors.count()
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-n // every // QUERY_BLOCK))
    few = [tuple(r) for r in least_by_hash(base, SAMPLE_ROWS, n, "vec_id").select("vec_id", "dim", "vector").collect()]
    sample = spark.sparkContext.broadcast(few)

    def first_bounds(batches):
        for batch in batches:
            ids, dims, raw = (batch.column(i).to_pylist() for i in range(3))
            least = np.full(len(ids), -float(LONG))
            for dim in set(dims):
                at = np.array([i for i, d in enumerate(dims) if d == dim])
                others = [(r[0], bytes(r[2])) for r in sample.value if r[1] == dim]
                v, small_v = codes([r[1] for r in others], dim)
                q, small_q = codes([raw[i] for i in at], dim)
                other_ids = np.array([r[0] for r in others], np.int64)
                for i, code, small in zip(at.tolist(), q, small_q, strict=True):
                    score = np.sort((v @ code)[small_v & (other_ids != ids[i])])
                    if small and len(score) >= k:
                        least[i] = score[-k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=["vec_id", "dim", "vector", "least"])

    rows = base.withColumn("r", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int"))
    rows = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = arrow_map(base.where(F.col("vec_id") % every == 0), first_bounds, "vec_id long, dim int, vector binary, least double")
    queries = queries.withColumn("g", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int"))
    queries = queries.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        found, large = [(np.zeros(0, np.int64),) * 3], []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            raw_q, raw_v = left.column("vector").to_pylist(), right.column("vector").to_pylist()
            query_ids, ids, least = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy(), left.column("least").to_numpy()
            (q, small_q), (v, small_v) = codes(raw_q, dim), codes(raw_v, dim)
            at = np.flatnonzero(small_q)
            top = block_top(query_ids[at], q[at], least[at], ids[small_v], v[small_v], k)
            found.append((query_ids[at][top[0]], *top[1:]))
            if not (small_q.all() and small_v.all()):
                large = large_top(query_ids, raw_q, ids, raw_v, ~(small_q[:, None] & small_v[None, :]), k)
                found += [tuple(np.array([x], np.int64) for x in (query_ids[i], row, max(-LONG, min(LONG, score)))) for i, row, score in large]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        beyond = [""] * (len(columns[0]) - len(large)) + [sortable(score) for _, _, score in large]
        return pa.table([*(pa.array(c, pa.int64()) for c in columns), pa.array(beyond, pa.string())], names=["query_id", "vec_id", "score", "beyond"])

    parts = queries.groupBy("g", "r", "dim").cogroup(rows.groupBy("g", "r", "dim")).applyInArrow(
        solve, "query_id long, vec_id long, score long, beyond string"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
