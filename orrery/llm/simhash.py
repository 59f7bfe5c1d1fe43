"""SimHash near-duplicates by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, arrow_map, as_bytes, cut, join_counted, pick, table
from .components import connected_components

SHINGLE_WORDS = 3
SEED = 42
BUDGET = 3
#: Tries are rooted at each 16-bit block of the fingerprint in turn; fingerprints within a budget
#: of 3 agree on one of the 4 blocks, so that in one of the tries they meet below one root.
BLOCKS, BLOCK_BITS = 4, 16
#: A root with more fingerprints than MANY_ROWS is taken apart: tries are rooted once more at each
#: quarter of the bits that remain, by the same argument. What still has more than ROOT_ROWS is
#: dealt into parts, FEW_PARTS at most unless a part would hold more than PART_ROWS; each pair of
#: parts is a task.
MANY_ROWS, REROOTS = 200_000, 2
ROOT_ROWS, FEW_PARTS, PART_ROWS = 2_000, 16, 100_000
#: Full roots up to this number (16 bytes each) are broadcast; beyond it they are joined.
BROADCAST_ROOTS = 300_000
#: Fingerprints that a task takes from its sorted input at a time, whole roots only.
CHUNK_ROWS = 400_000


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64 bits, each 1 if it is set in over half of the hashes of the text's shingles."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -shingle_words].tolist()]
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype=">u8", count=len(starts))
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(texts: pa.Array) -> list[pa.Array]:
    return [pa.array([_signed(fingerprint(t)) for t in as_bytes(texts)], pa.int64())]


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp", drop: Sequence[str] = ()) -> DataFrame:
    """docs with the fingerprint of each whole text as a signed number; null and empty texts have 0.
    Other columns, but for those named in drop, pass through."""
    return append_columns(docs, [text_col], _fingerprints, [T.StructField(name, T.LongType())], drop)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """Union by smallest member over positions 0..n-1, on whole arrays of links at a time."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def trie_links(values: np.ndarray, group: np.ndarray, bits: int, budget: int) -> np.ndarray:
    """For each position the smallest position that it is linked with, directly or not, within
    its group, where two of a group link if their values differ in at most budget bits.

    values (unsigned, of so many bits) must ascend within ascending groups. The trie over them is
    implicit: a node is a range of positions with a common prefix. Pairs of nodes of equal depth
    are traversed together from the roots; where both prefixes part, one differing bit is
    accumulated, and a pair over the budget is dropped with all below it. The budget is deepened
    step by step, and pairs whose members are all one component already are dropped too, so large
    groups of near copies cost little more than their number.
    """
    n = len(values)
    forest = Forest(n)
    if n < 2:
        return forest.root
    cuts = np.flatnonzero(np.diff(group)) + 1
    lo, hi = np.r_[0, cuts], np.r_[cuts, n]
    keep = hi - lo > 1
    for allowed in range(1, budget + 1):
        start = (lo[keep], hi[keep], lo[keep], hi[keep], np.zeros(keep.sum(), np.int64))
        stack = [(0, start)]
        while stack:
            depth, pairs = stack.pop()
            l1, h1, l2, h2, diff = pairs
            changes = np.r_[0, np.cumsum(forest.root[1:] != forest.root[:-1])]
            one = (changes[h1 - 1] == changes[l1]) & (changes[h2 - 1] == changes[l2]) & (forest.root[l1] == forest.root[l2])
            small = (h1 - l1) * (h2 - l2) <= 16
            at_end = depth == bits
            todo = small & ~one
            if todo.any():
                s1, s2 = h1[todo] - l1[todo], h2[todo] - l2[todo]
                count = s1 * s2
                at = np.repeat(np.arange(len(count)), count)
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                i, j = l1[todo][at] + k // s2[at], l2[todo][at] + k % s2[at]
                close = (i != j) & (_popcount(values[i] ^ values[j]) <= allowed)
                forest.link(i[close], j[close])
            go = ~one & ~small
            if at_end or not go.any():
                if at_end and go.any():  # equal prefixes to the last bit: all of both nodes link
                    for a, b, c, d in zip(l1[go], h1[go], l2[go], h2[go], strict=True):
                        span = np.r_[np.arange(a, b), np.arange(c, d)]
                        forest.link(span[:1].repeat(len(span) - 1), span[1:])
                continue
            l1, h1, l2, h2, diff = (x[go] for x in (l1, h1, l2, h2, diff))
            m1, m2 = _split(values, l1, h1, bits - 1 - depth), _split(values, l2, h2, bits - 1 - depth)
            own = l1 == l2
            zero, ones = (l1, m1, l2, m2, diff), (m1, h1, m2, h2, diff)
            up, down = (l1, m1, m2, h2, diff + 1), (m1[~own], h1[~own], l2[~own], m2[~own], diff[~own] + 1)
            made = [np.concatenate(x) for x in zip(down, up, ones, zero, strict=True)]
            fits = (made[0] < made[1]) & (made[2] < made[3]) & (made[4] <= allowed)
            fits &= ~((made[0] == made[2]) & (made[1] - made[0] < 2))
            made = [x[fits] for x in made]
            for k in range(0, len(made[0]), 200_000):
                stack.append((depth + 1, tuple(x[k : k + 200_000] for x in made)))
    return forest.root


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """The first position of each range (ascending but for bits above) whose bit is set: a
    bisection of all ranges at once."""
    lo, hi = lo.copy(), hi.copy()
    mask = np.uint64(1 << bit)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        is_set = (values[np.minimum(mid, len(values) - 1)] & mask) != 0
        hi = np.where(open_ & is_set, mid, hi)
        lo = np.where(open_ & ~is_set, mid + 1, lo)
    return lo


def _star_links(bits, batches):
    """Links (member, smallest id) of the components under each root, whose trie is over the bits
    that remain; the input is sorted by root and part pair, so that whole roots are taken a chunk
    at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(root, i, j, rest, ids):
        if not len(root):
            return
        key = np.stack([root, i, j])
        group = np.r_[0, np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))]
        rest = rest.view(np.uint64)
        order = np.lexsort((rest, group))
        group, rest, ids = group[order], rest[order], ids[order]
        found = trie_links(rest, group, bits, BUDGET)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, found, ids)
        least = least[found]
        link = least != ids
        yield pa.RecordBatch.from_arrays([pa.array(ids[link]), pa.array(least[link])], schema=schema)

    held = [np.zeros(0, np.int64) for _ in range(5)]
    waiting, rows = [], 0
    for batch in batches:
        waiting.append([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)])
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            held = [np.concatenate([h, *(w[k] for w in waiting)]) for k, h in enumerate(held)]
            waiting, rows = [], 0
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            end = len(last) - int(last.sum())
            yield from solve(*(h[:end] for h in held))
            held = [h[end:] for h in held]
    held = [np.concatenate([h, *(w[k] for w in waiting)]) for k, h in enumerate(held)]
    yield from solve(*held)


def rooted(rows: DataFrame, bits: int) -> DataFrame:
    """rows (root, rest, id) four times over: below their root a further one for each quarter of
    their remaining bits (rest, so many), whose trie is over the other three quarters."""
    quarter = bits // BLOCKS
    spread = rows.select("root", "rest", "id", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("k"))
    low = f"({bits} - {quarter} * (k + 1))"
    own = F.expr(f"shiftrightunsigned(rest, {low}) & {(1 << quarter) - 1}L")
    above = F.expr(f"CASE WHEN k = 0 THEN 0L ELSE shiftleft(shiftrightunsigned(rest, {low} + {quarter}), {low}) END")
    below = F.expr(f"rest & (shiftleft(1L, {low}) - 1L)")
    root = (F.col("root") * BLOCKS + F.col("k")) * (1 << quarter) + own
    return spread.select(root.alias("root"), above.bitwiseOR(below).alias("rest"), "id")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints (columns fp, id), enough to join all
    within BUDGET bits of each other, directly or through others."""
    bits = BLOCKS * BLOCK_BITS
    rows = prints.select(F.lit(0).cast("long").alias("root"), F.col("fp").alias("rest"), "id")
    links = None
    for again in range(REROOTS + 1):
        rows, bits = rooted(rows, bits), bits - bits // BLOCKS
        # one root in ROOT_ROWS rows at most
        full = cut(rows.groupBy("root").count().where(F.col("count") > ROOT_ROWS))
        found = full.selectExpr("count(*) AS roots", f"count_if(count > {MANY_ROWS}) AS many").first()
        shared = F.broadcast(full) if found["roots"] <= BROADCAST_ROOTS else full
        known = rows.join(shared, "root", "left")
        last = again == REROOTS or not found["many"]
        ready = _star_links_of(known if last else known.where(F.coalesce("count", F.lit(0)) <= MANY_ROWS), bits)
        links = ready if links is None else links.unionByName(ready)
        if last:
            return links
        rows = known.where(F.col("count") > MANY_ROWS).select("root", "rest", "id")


def _star_links_of(rows: DataFrame, bits: int) -> DataFrame:
    """The links below each root of rows (root, count if it is a full one, rest, id)."""
    count = F.coalesce("count", F.lit(1))
    parts = F.greatest(F.least(F.lit(FEW_PARTS), F.ceil(count / ROOT_ROWS)), F.ceil(count / PART_ROWS)).cast("int")
    dealt = rows.select("root", "rest", "id", parts.alias("parts"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    # two parts that meet are held against themselves as well
    dealt = dealt.where("own <> other OR parts = 1").select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rest", "id"
    )
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return arrow_map(dealt, partial(_star_links, bits), "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64 bits) and component_id of every row: the smallest id reachable over
    links of at most BUDGET differing bits.

    Equal fingerprints are one node, so copies cost no pairs. Texts that are null, empty or white
    space have fingerprint 0, which links like any other. A row without an id links with nothing
    and has a null component; rows that share an id share its component (the smallest over all
    their texts). An empty table gives no rows; extra columns are ignored.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    made = cut(with_fingerprint(base, drop=["text"]))
    named = made.where("doc_id IS NOT NULL")
    prints = cut(named.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    links = fingerprint_links(prints.select("fp", "id"))
    # an id met with several texts joins their fingerprints
    repeated = named.distinct().groupBy("doc_id").agg(F.count("*").alias("n"), F.min("fp").alias("fp0")).where("n > 1")
    bridges = (
        named.join(repeated, "doc_id").select("fp", "fp0").distinct()
        .join(prints.select("fp", F.col("id").alias("a")), "fp")
        .join(prints.select(F.col("fp").alias("fp0"), F.col("id").alias("b")), "fp0")
        .select("a", "b")
    )
    found = connected_components(links.unionByName(bridges))
    group = prints.join(found.withColumnRenamed("node", "id"), "id", "left")
    group = cut(group.select("fp", F.coalesce("component", "id").alias("component_id"), "n"))
    known = join_counted(named, group, "fp").select("doc_id", "fp", "component_id")
    nameless = made.where("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(nameless)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each group: that with the smallest id. Rows without an id stay; of
    rows that share an id one stays, and all go if their id isn't the smallest of its group. Null,
    empty and blank texts are one group, with whatever else has few bits set. All columns are kept,
    whatever their names; an empty table stays empty."""
    width, names = len(docs.columns), docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(width)])
    key = f"c{names.index(id_col)}"
    groups = cut(simhash_groups(docs, id_col, text_col).where("doc_id IS NOT NULL").select("doc_id", "component_id"))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    twice = groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("gone"))
    once = flat.join(gone.unionByName(twice).distinct(), F.col(key) == F.col("gone"), "left_anti")
    left = twice.join(gone, "gone", "left_anti")
    again = flat.join(left, F.col(key) == F.col("gone"), "left_semi").dropDuplicates([key])
    return once.unionByName(again).toDF(*names)


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
