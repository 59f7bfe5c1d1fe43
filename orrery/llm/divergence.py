"""Audit of how the sources of a language differ in their words, by mergeable radix tries."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, cut, pick, table
from .words import by_group, byte_classes, coded_column, flat_bytes, shards, split_words

#: Terms are runs of ASCII letters and characters beyond ASCII.
CLASSES = byte_classes(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Leaves of a twig, the part of a trie that travels as one row, and of a page of merged ones.
TWIG_LEAVES, PAGE_LEAVES = 1_024, 1_024
#: Leaves of all tries that one prefix range holds, about, and the most ranges; leaves that a task
#: holds before it merges them.
RANGE_LEAVES, MOST_RANGES, MERGE_LEAVES = 250_000, 10_000, 400_000
#: First keys of so many twigs at most, and so many bytes of each, are sampled to place the ranges.
SAMPLED, SAMPLED_BYTES = 20_000, 64
#: Sources that are held against each other at a time.
BLOCK_SOURCES = 64
#: Sums that a task holds before it passes them on.
HELD_SUMS = 1 << 20

TWIG_SCHEMA = "leaves long, least binary, most binary, sources array<string>, twig binary"
PAGE_SCHEMA = "lang string, terms array<string>, sources array<string>, sums array<long>, page binary"
FOUND_SCHEMA = "lang string, source string, part string, item string, value long"


def radix_order(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The radix trie of different keys, as its leaves in the order of a traversal (that of their bytes)
    and for each leaf the depth at which its branch leaves that of the one before: a node is a run of
    leaves that part no higher. It grows a byte at a time: all nodes of a depth are branched
    together, and a branch with one key left is a leaf."""
    data, starts = flat_bytes(keys)
    length = np.diff(starts)
    order, shared = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    active, node = np.arange(len(length)), np.zeros(len(length), np.int64)
    depth = 0
    while len(active):
        there = length[active] > depth
        byte = np.zeros(len(active), np.int64)  # a key that ends here comes first
        byte[there] = data[starts[active[there]] + depth].astype(np.int64) + 1
        by = np.lexsort((byte, node)) if depth else np.argsort(byte, kind="stable")
        active, node, byte = active[by], node[by], byte[by]
        begins = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (byte[1:] != byte[:-1])]))
        size = np.diff(np.append(begins, len(active)))
        parent_begins = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        offset = begins - parent_begins[np.searchsorted(parent_begins, begins, "right") - 1]
        first = node[begins] + offset  # a node is known by the place of its first leaf
        shared[first[offset > 0]] = depth
        order[first[size == 1]] = active[begins[size == 1]]
        more = np.repeat(size > 1, size)
        active, node = active[more], np.repeat(first, size)[more]
        depth += 1
    return order, shared


class Leaves:
    """The leaves of a trie in order: keys (language, a zero byte, term), how far each shares the one
    before it, how many documents hold it, and its counters by source (of leaf i those from at[i] to
    at[i + 1]: number in sources, and count)."""

    def __init__(self, keys: pa.Array, docs: np.ndarray, leaf: np.ndarray, source: np.ndarray, count: np.ndarray, sources: list[str]) -> None:
        """keys are different, in any order; leaf is the number of the key that a counter belongs to.
        Counters of one key and source are added up."""
        order, self.shared = radix_order(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pair, at = np.unique(place[leaf] * max(1, len(sources)) + source, return_inverse=True)
        self.count = np.zeros(len(pair), np.int64)
        np.add.at(self.count, at, count)
        leaf, self.source = np.divmod(pair, max(1, len(sources)))
        self.at = np.searchsorted(leaf, np.arange(len(order) + 1))
        self.keys, self.docs, self.sources = keys.take(pa.array(order)), docs[order], sources

    def __len__(self) -> int:
        return len(self.docs)

    @classmethod
    def merged(cls, tries: list[Leaves]) -> Leaves:
        """One trie of several: equal leaves become one, their counters are added."""
        if len(tries) == 1:
            return tries[0]
        names: dict[str, int] = {}
        own = [np.array([names.setdefault(s, len(names)) for s in t.sources], np.int64) for t in tries]
        coded = pa.concat_arrays([t.keys for t in tries]).dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        docs = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(docs, number, np.concatenate([t.docs for t in tries]))
        leaf = np.repeat(number, np.concatenate([np.diff(t.at) for t in tries]))
        source = np.concatenate([o[t.source] for o, t in zip(own, tries, strict=True)])
        return cls(coded.dictionary, docs, leaf, source, np.concatenate([t.count for t in tries]), list(names))

    def packed(self, lo: int, hi: int) -> bytes:
        """The leaves from lo to hi: of each key only the bytes below the branch."""
        data, starts = flat_bytes(self.keys.slice(lo, hi - lo))
        shared = self.shared[lo:hi].copy()
        shared[:1] = 0
        length = np.diff(starts) - shared
        at = np.arange(length.sum()) + np.repeat(starts[:-1] + shared - (np.cumsum(length) - length), length)
        a, b = self.at[lo], self.at[hi]
        parts = [shared, length, self.docs[lo:hi], np.diff(self.at[lo : hi + 1]), self.source[a:b], self.count[a:b]]
        head = np.array([hi - lo, b - a], np.int64)
        raw = b"".join([head.tobytes(), *[p.astype(np.int64).tobytes() for p in parts], data[at].tobytes()])
        return zstandard.compress(raw, 1)

    def used(self, lo: int, hi: int) -> tuple[list[str], np.ndarray]:
        """The sources that count in these leaves, and the new numbers of all."""
        there = np.unique(self.source[self.at[lo] : self.at[hi]])
        renumbered = np.zeros(max(1, len(self.sources)), np.int64)
        renumbered[there] = np.arange(len(there))
        return [self.sources[i] for i in there.tolist()], renumbered

    @classmethod
    def unpacked(cls, held: bytes, sources: list[str]) -> Leaves:
        made = cls.__new__(cls)
        raw = zstandard.decompress(held)
        n, counters = np.frombuffer(raw, np.int64, 2).tolist()
        made.sources, at, parts = sources, 16, []
        for size in (n, n, n, n, counters, counters):
            parts.append(np.frombuffer(raw, np.int64, size, at))
            at += 8 * size
        made.shared, length, made.docs, each, made.source, made.count = parts
        made.at = np.concatenate([[0], np.cumsum(each)])
        keys, before = [], b""
        for shared, size in zip(made.shared.tolist(), length.tolist(), strict=True):
            before = before[:shared] + raw[at : at + size]
            keys.append(before)
            at += size
        made.keys = pa.array(keys, pa.binary())
        return made

    def cut(self, lo: int, hi: int) -> Leaves:
        made = Leaves.__new__(Leaves)
        a, b = self.at[lo], self.at[hi]
        made.keys, made.docs, made.at = self.keys.slice(lo, hi - lo), self.docs[lo:hi], self.at[lo : hi + 1] - a
        made.source, made.count, made.sources, made.shared = self.source[a:b], self.count[a:b], self.sources, self.shared[lo:hi]
        return made


def _twig(trie: Leaves, lo: int, hi: int) -> tuple:
    names, renumbered = trie.used(lo, hi)
    own = trie.cut(lo, hi)
    own.source = renumbered[own.source]
    return hi - lo, own.keys[0].as_py(), own.keys[-1].as_py(), names, own.packed(0, hi - lo)


def _rows(rows: list[tuple], schema: str, more: dict | None = None) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*[field.strip().split(" ") for field in schema.split(",")], strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def local_trie(langs: pa.ChunkedArray, sources: pa.ChunkedArray, texts: pa.ChunkedArray) -> Leaves:
    """The trie of some whole documents."""
    lang_names, lang = coded_column(langs, "")
    source_names, source = coded_column(sources, "")
    w = split_words(texts, CLASSES)
    of_lang, of_word, leaf = by_group(lang[w.text], w.word, len(w.dictionary))
    leaves = max(1, len(of_word))
    pair, count = np.unique(w.text.astype(np.int64) * leaves + leaf, return_counts=True)
    text, leaf = np.divmod(pair, leaves)
    docs = np.bincount(leaf, minlength=len(of_word))
    keys = pc.binary_join_element_wise(lang_names.cast(pa.binary()).take(pa.array(of_lang)), w.dictionary.take(pa.array(of_word)), b"\0")
    return Leaves(keys, docs, leaf, source[text], count, source_names.to_pylist())


def _local(batches):
    for held in shards(batches, 2):
        trie = local_trie(held.column(0), held.column(1), held.column(2))
        twigs = [_twig(trie, lo, min(lo + TWIG_LEAVES, len(trie))) for lo in range(0, len(trie), TWIG_LEAVES)]
        for lo in range(0, len(twigs), 64):
            yield _rows(twigs[lo : lo + 64], TWIG_SCHEMA)


def _by_range(bounds):
    """Each twig, cut where ranges meet, with the number of its range before it."""

    def run(batches):
        for batch in batches:
            rows = []
            for leaves, least, most, sources, twig in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                first, last = bisect_right(bounds.value, least), bisect_right(bounds.value, most)
                if first == last:
                    rows.append((first, leaves, least, most, sources, twig))
                    continue
                trie = Leaves.unpacked(twig, sources)
                of = [bisect_right(bounds.value, k) for k in trie.keys.to_pylist()]
                edges = [0, *[i for i in range(1, len(of)) if of[i] != of[i - 1]], len(of)]
                rows += [(of[lo], *_twig(trie, lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
            yield _rows(rows, "range int, " + TWIG_SCHEMA)

    return run


def _pages(trie: Leaves, least: int) -> Iterator[tuple]:
    """The leaves in at least so many documents, some of one language to a page."""
    kept = np.flatnonzero(trie.docs >= least)
    keys = [trie.keys[i].as_py() for i in kept.tolist()]
    for lang, run in groupby(zip(kept.tolist(), keys, strict=True), lambda x: x[1].rpartition(b"\0")[0]):
        run = list(run)
        for lo in range(0, len(run), PAGE_LEAVES):
            some = run[lo : lo + PAGE_LEAVES]
            at = np.array([i for i, _ in some])
            each = trie.at[at + 1] - trie.at[at]
            of = np.arange(each.sum()) + np.repeat(trie.at[at] - (np.cumsum(each) - each), each)
            there, source = np.unique(trie.source[of], return_inverse=True)
            count = trie.count[of]
            sums = np.zeros(len(there), np.int64)
            np.add.at(sums, source, count)
            held = b"".join(x.astype(np.int64).tobytes() for x in (each, source, count))
            terms = [k.rpartition(b"\0")[2].decode() for _, k in some]
            yield lang.decode(), terms, [trie.sources[i] for i in there.tolist()], sums.tolist(), zstandard.compress(held, 1)


def _merged(least: int):
    def run(batches):
        rows = ((r, s, t) for b in batches for r, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        for _, mine in groupby(rows, lambda x: x[0]):
            held, size, base = [], 0, 0
            for _, sources, twig in mine:
                held.append(Leaves.unpacked(twig, sources))
                size += len(held[-1])
                if size >= max(MERGE_LEAVES, 2 * base):  # what is merged already is merged again only once it has doubled
                    held = [Leaves.merged(held)]
                    size = base = len(held[0])
            pages = list(_pages(Leaves.merged(held), least))
            for lo in range(0, len(pages), 32):
                yield _rows(pages[lo : lo + 32], PAGE_SCHEMA)

    return run


def merged_pages(docs: DataFrame, lang_col: str, source_col: str, text_col: str, least: int) -> DataFrame:
    """The terms in at least so many documents of their language, with their counts by source: rows of
    PAGE_SCHEMA. Each task builds tries of its documents, whose leaves are dealt by prefix ranges and
    merged range by range."""
    spark = docs.sparkSession
    twigs = cut(arrow_map(pick(docs, lang=lang_col, source=source_col, text=text_col), _local, TWIG_SCHEMA))
    size = twigs.agg(F.count("*"), F.sum("leaves")).first()
    ranges = min(MOST_RANGES, -(-(size[1] or 0) // RANGE_LEAVES) or 1)
    bounds: list[bytes] = []
    if ranges > 1:
        share = min(1.0, SAMPLED / 2 / size[0])
        drawn = twigs.where(F.pmod(F.xxhash64("twig"), F.lit(1_000_000)) < int(share * 1_000_000))
        sample = sorted(bytes(r[0]) for r in drawn.select(F.substring("least", 1, SAMPLED_BYTES)).limit(SAMPLED).collect())
        bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    dealt = arrow_map(twigs, _by_range(spark.sparkContext.broadcast(bounds)), "range int, " + TWIG_SCHEMA)
    dealt = dealt.select("range", "sources", "twig").repartition(ranges, "range").sortWithinPartitions("range")
    return cut(arrow_map(dealt, _merged(least), PAGE_SCHEMA))


def shares_of(count: np.ndarray, of: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * (count + 1) / of), divided three digits at a time: exact below 9 * 10^15."""
    rest, found = count + 1, np.zeros(np.broadcast(count, of).shape, np.int64)
    while scale > 1:
        whole, rest = np.divmod(rest * 1000, of)
        found = found * 1000 + whole
        scale //= 1000
    return found + 1


def _compared(top: int):
    """Sums of each pair of sources over the pages of a task, and its best terms of each source."""

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        best: dict[tuple, list] = {}
        held = 0

        def flush():
            for (lang, a, b), found in sums.items():
                rows = [(lang, s, "pair", t, v) for s, line in zip(a, found.tolist(), strict=True) for t, v in zip(b, line, strict=True) if s != t]
                if rows:
                    yield _rows(rows, FOUND_SCHEMA)
            for (lang, s), found in best.items():
                yield _rows([(lang, s, "term", term.decode(), -v) for v, term in found], FOUND_SCHEMA)
            sums.clear()
            best.clear()

        for batch in batches:
            for lang, terms, sources, page, block, words, other, other_words, total, kept in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = np.frombuffer(zstandard.decompress(page), np.int64)
                each, rest = raw[: len(terms)], raw[len(terms) :]
                of, count = rest[: len(rest) // 2], rest[len(rest) // 2 :]
                leaf = np.repeat(np.arange(len(terms)), each)

                def dense(names, sums_, leaf=leaf, of=of, count=count, terms=terms, sources=sources, kept=kept):
                    place = {s: i for i, s in enumerate(names)}
                    column = np.array([place.get(s, -1) for s in sources], np.int64)[of]
                    here = column >= 0
                    made = np.zeros((len(terms), len(names)), np.int64)
                    made[leaf[here], column[here]] = count[here]
                    return made, shares_of(made, np.array(sums_, np.int64) + kept)

                own, p = dense(block, words)
                same = block == other
                q = p if same else dense(other, other_words)[1]
                key = (lang, tuple(block), tuple(other))
                if key not in sums:
                    held += len(block) * len(other)
                    sums[key] = np.zeros((len(block), len(other)), np.int64)
                for i in range(len(block)):
                    step = p[:, i : i + 1] - q
                    sums[key][i] += (step * step // q).sum(axis=0)
                if same:
                    whole = np.zeros(len(terms), np.int64)
                    np.add.at(whole, leaf, count)
                    all_ = shares_of(whole, np.int64(total + kept))
                    for i, s in enumerate(block):
                        at = np.flatnonzero((own[:, i] > 0) & (p[:, i] > all_))
                        step = p[at, i] - all_[at]
                        value = step * step // all_[at]
                        at_best = np.argsort(-value, kind="stable")[:top]  # ties stay in the order of the traversal
                        more = [(-int(value[j]), terms[at[j]].encode()) for j in at_best.tolist()]
                        if more:
                            before = best.get((lang, s), [])
                            held += len(more) - len(before)
                            best[lang, s] = sorted(before + more)[:top]
                            held += len(best[lang, s]) - len(more)
                if held > HELD_SUMS:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCS, top: int = TOP
) -> DataFrame:
    """How each source of a language differs from each other one (part `pair`, all ranks) and which
    terms it has more of than the language (part `term`, the first 200): lang, source, part, item,
    value, rank.

    A term counts if at least 3 documents of the language hold it. Null texts, languages and sources
    are empty; a repeated row is a document of its own; texts of any length are read whole; equal
    values are ordered by the item's bytes; sources without terms, and languages without kept ones,
    have their pairs; an empty table gives no rows; other columns are ignored, whatever their names.
    Counts are exact below 9 * 10^15."""
    pages = merged_pages(docs, lang_col, source_col, text_col, least)
    named = pick(docs, lang=lang_col, source=source_col)
    named = named.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counted = pages.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x"))
    counted = counted.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("words"))
    groups = cut(named.join(counted, ["lang", "source"], "left").select("lang", "source", F.coalesce("words", F.lit(0).cast("long")).alias("words")))
    of_lang = groups.groupBy("lang").agg(F.sum("words").alias("total"), F.count("*").alias("groups"))
    kept = pages.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("kept"))
    block = F.pmod(F.xxhash64("source"), F.ceil(F.col("groups") / BLOCK_SOURCES)).alias("block")
    blocks = groups.join(of_lang, "lang").groupBy("lang", block).agg(F.collect_list(F.struct("source", "words")).alias("held"))
    blocks = cut(blocks.select("lang", F.col("held.source").alias("block"), F.col("held.words").alias("words")))
    pairs = blocks.join(blocks.select("lang", F.col("block").alias("other"), F.col("words").alias("other_words")), "lang")
    pairs = pairs.join(of_lang.select("lang", "total"), "lang").join(kept, "lang")
    met = pages.join(pairs, "lang").select("lang", "terms", "sources", "page", "block", "words", "other", "other_words", "total", "kept")
    found = cut(arrow_map(met, _compared(top), FOUND_SCHEMA))
    summed = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    bare = groups.join(kept, "lang", "left_anti")
    bare = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    bare = bare.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return summed.unionByName(bare).withColumn("rank", F.row_number().over(by_value)).unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
