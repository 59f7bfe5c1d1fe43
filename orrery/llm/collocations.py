"""Phrase collocations by position bitmaps: shift, AND and popcount, depth-first, shard by shard."""

from __future__ import annotations

import pickle
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, cut, pick, table
from .words import Members, by_group, byte_classes, coded_column, hashes, in_group, joined, members, mixed, paired, shards, split_words

#: Words are parted by spaces and tabs; pieces, which no phrase crosses, by these as well.
CLASSES = byte_classes(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
NO_LANG = "und"
MOST_WORDS, LEAST_COUNT, SCALE, COVERED, TOP = 4, 30, 2_000_000, 80, 2_000
#: Positions of one byte of a bitmap. Bytes without a set bit are left out.
BLOCK = 8
#: Bytes of bitmaps extended at a time, and ANDs made at a time.
BATCH_ENTRIES, ANDS_AT_ONCE = 1 << 16, 1 << 18
#: Positions whose bitmaps are held at a time.
SPAN = 1 << 20
#: Words and phrases are first summed by the top bits of their hash, in so many buckets (as many as
#: shards, within bounds); a task passes its sums on when it holds so many.
HASH_BITS, BUCKETS, HELD_SUMS = 40, (16, 4096), 1 << 20
#: Shares in which the best phrases of a language are found before they meet.
SALTS = (64, 8)

#: A shard is stored in pieces of so many bytes, in order, as rows of megabytes burden the JVM's heap.
PIECE_BYTES = 256 << 10
SHARD_SCHEMA = "piece binary, last boolean"
FIRST = np.uint32(1 << 31)


class Shard:
    """The words of some whole texts in order. A term is a word in a language: lang[t] and word[t]
    are its parts, terms[i] the term at the i-th place, first[i] whether a piece begins there."""

    def __init__(self, langs: pa.Array, words: pa.Array, lang: np.ndarray, word: np.ndarray, terms: np.ndarray, first: np.ndarray) -> None:
        self.langs, self.words, self.lang, self.word, self.terms, self.first = langs, words, lang, word, terms, first

    def hash(self) -> np.ndarray:
        return in_group(hashes(self.langs)[self.lang], hashes(self.words)[self.word]) if len(self.word) else np.zeros(0, np.uint64)

    def phrases(self, columns: list[np.ndarray]) -> list[pa.Array]:
        """lang and phrase, columns being the terms at each place of a phrase."""
        return [self.langs.take(pa.array(self.lang[columns[0]])), joined([self.words.take(pa.array(self.word[c])) for c in columns])]


def _encoded(batches):
    for held in shards(batches, 1):
        langs, lang = coded_column(held.column(0), NO_LANG)
        w = split_words(held.column(1), CLASSES)
        of_lang, of_word, term = by_group(lang[w.text], w.word, len(w.dictionary))
        lengths = pc.binary_length(w.dictionary).to_numpy(zero_copy_only=False)
        parts = (
            langs.to_pylist(), b"".join(w.dictionary.to_pylist()), np.cumsum(lengths, dtype=np.int64),
            of_lang.astype(np.int32), of_word.astype(np.int32), term.astype(np.uint32) | (w.first * FIRST),
        )
        whole = zstandard.compress(pickle.dumps(parts, protocol=5), 1)
        pieces = [whole[k : k + PIECE_BYTES] for k in range(0, len(whole), PIECE_BYTES)]
        last = [k == len(pieces) - 1 for k in range(len(pieces))]
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()), pa.array(last)], names=["piece", "last"])


def _decoded(batches):
    held = []
    for batch in batches:
        for piece, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append(piece)
            if last:
                langs, words, ends, lang, word, sequence = pickle.loads(zstandard.decompress(b"".join(held)))
                held = []
                ends = np.concatenate([[0], ends]).astype(np.int64)
                names = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(words)])
                yield Shard(pa.array(langs, pa.string()), names, lang, word, (sequence & ~FIRST).astype(np.int32), sequence >= FIRST)


def encoded_shards(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """docs as shards of some megabytes of whole texts each; the rows of one follow each other."""
    return arrow_map(pick(docs, lang=lang_col, text=text_col), _encoded, SHARD_SCHEMA)


class Bitmaps:
    """The positions of the terms of a span, a bitmap for each term: bytes by term, and the same bytes
    by place, which is what a shifted bitmap is ANDed with. One position is left free between pieces,
    so no shift leads from one into the next. Starts lie before the position `till`: places after it
    only continue phrases."""

    def __init__(self, terms: np.ndarray, first: np.ndarray, keep: np.ndarray, till: int) -> None:
        where = np.arange(len(terms), dtype=np.int64) + np.cumsum(first)
        stop = int(where[till - 1]) + 1 if till else 0
        where, terms = where[keep[terms]], terms[keep[terms]]
        self.ends = np.zeros(1, np.int64)
        if not len(where):
            self.term = self.block = self.bits = np.zeros(0, np.int64)
            return
        key = (where // BLOCK) * len(keep) + terms
        order = np.argsort(key)
        key, bit = key[order], np.left_shift(np.uint16(1), (where[order] % BLOCK).astype(np.uint16))
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.bits = np.bitwise_or.reduceat(bit, at)
        self.block, self.term = np.divmod(key[at], len(keep))
        self.block, self.term = self.block.astype(np.int32), self.term.astype(np.int32)
        self.ends = np.searchsorted(self.block, np.arange(self.block[-1] + 3))
        start = self.bits.copy()  # of these, the positions where a phrase of this span may start
        edge = stop // BLOCK
        start[self.block > edge] = 0
        start[self.block == edge] &= np.uint16((1 << stop % BLOCK) - 1)
        self.start = start

    def batches(self):
        """Whole bitmaps of terms that follow each other, some bytes at a time."""
        order = np.argsort(self.term, kind="stable")
        order = order[self.start[order] > 0]
        if not len(order):
            return
        lo = 0
        while lo < len(order):
            hi = min(lo + BATCH_ENTRIES, len(order))
            if hi < len(order):
                hi = int(np.searchsorted(self.term[order], self.term[order[hi]]))
                if hi <= lo:
                    hi = int(np.searchsorted(self.term[order], self.term[order[lo]], "right"))
            at = order[lo:hi]
            yield self.term[at], self.block[at], self.start[at]
            lo = hi

    def extend(self, last: np.ndarray, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray, allowed):
        """The bitmaps of phrases (their last terms given), shifted by one and ANDed with those of the terms
        at the places that they reach: phrase, next term, block and bits wherever a bit is left.
        allowed(last, next) drops pairs that can't be in a frequent phrase."""
        bits = bits << np.uint16(1)
        over = np.flatnonzero(bits >> np.uint16(BLOCK))
        inner = np.flatnonzero(bits & np.uint16((1 << BLOCK) - 1))
        at = np.concatenate([inner, over])
        block = np.concatenate([block[inner], block[over] + 1])
        bits = np.concatenate([bits[inner] & np.uint16((1 << BLOCK) - 1), bits[over] >> np.uint16(BLOCK)])
        known = block < len(self.ends) - 1
        at, block, bits = at[known], block[known], bits[known]
        lo, n = self.ends[block], self.ends[block + 1] - self.ends[block]
        found = []
        steps = np.concatenate([[0], np.cumsum(n)])
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(steps, steps[begin] + ANDS_AT_ONCE, "right")) - 1)
            some = np.repeat(np.arange(begin, end), n[begin:end])
            other = np.arange(len(some)) + np.repeat(lo[begin:end] - (steps[begin:end] - steps[begin]), n[begin:end])
            both = bits[some] & self.bits[other]
            hit = np.flatnonzero(both)
            some, other, both = some[hit], other[hit], both[hit]
            if allowed is not None:
                fine = np.flatnonzero(allowed(last[at[some]], self.term[other]))
                some, other, both = some[fine], other[fine], both[fine]
            found.append((phrase[at[some]], self.term[other], block[some], both))
            begin = end
        return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


def mine(shard: Shard, keep: np.ndarray, allowed, words: int, fits=None):
    """(terms at each place, count) of the phrases of 2 to so many words: each batch of bitmaps is
    extended to the end before the next one. Phrases of terms that keep doesn't hold, with pairs that
    allowed() drops, or that fits(terms at each place) drops, are left out with all that they begin."""
    width = len(keep)
    for lo in range(0, len(shard.terms), SPAN):
        hi = min(lo + SPAN, len(shard.terms))
        beyond = min(hi + words - 1, len(shard.terms))
        maps = Bitmaps(shard.terms[lo:beyond], shard.first[lo:beyond], keep, hi - lo)
        if not len(maps.bits):
            continue
        for term, block, bits in maps.batches():
            columns, phrase = [term], np.arange(len(term))
            ids, phrase = np.unique(term, return_inverse=True)
            columns, last = [ids], term
            for _ in range(words - 1):
                found = maps.extend(last, phrase, block, bits, allowed)
                if found is None or not len(found[0]):
                    break
                before, last, block, bits = found
                pair, phrase = np.unique(before.astype(np.int64) * width + last, return_inverse=True)
                count = np.bincount(phrase, np.bitwise_count(bits), len(pair)).astype(np.int64)
                head, tail = np.divmod(pair, width)
                columns = [c[head] for c in columns] + [tail]
                if fits is not None:
                    fine = fits(columns)
                    columns, count, here = [c[fine] for c in columns], count[fine], fine[phrase]
                    phrase, last, block, bits = (np.cumsum(fine) - 1)[phrase[here]], last[here], block[here], bits[here]
                yield columns, count


def _batch(lang, phrase, count):
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(count, pa.int64())], names=["lang", "phrase", "a"])


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers by their bytes' places, which compresses well where most are small."""
    return zstandard.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _of_planes(held: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(held), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and the sums of their counts."""
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.uint64)


def _key(h: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """The top bits of the hash of each phrase, h being the terms' hashes."""
    made = h[columns[0]]
    for c in columns[1:]:
        made = paired(made, h[c])
    return made >> np.uint64(64 - HASH_BITS)


def _among(filters, h: np.ndarray):
    """What tells whether phrases pass a filter of keys."""
    held = Members(filters.value)
    return lambda *columns: held.has(mixed(_key(h, columns)))


def _counted(shard: Shard, filters: list, words: int):
    """(terms at each place, count) of the words, or of the phrases of so many words whose words, pairs and
    so on pass the filters of those sizes; the last filter is for that size and all beyond."""
    h = shard.hash()
    every = np.arange(len(shard.word))
    if not filters:
        yield [every], np.bincount(shard.terms, minlength=len(every))
        return
    keep = _among(filters[0], h)(every) if len(every) else np.zeros(0, bool)
    allowed = _among(filters[1], h) if len(filters) > 1 else None
    longer = _among(filters[2], h) if len(filters) > 2 else None
    fits = None if longer is None else lambda columns: longer(*columns) if len(columns) > 2 else np.ones(len(columns[0]), bool)
    if longer is not None:
        yield [every[keep]], np.bincount(shard.terms, minlength=len(every))[keep]
    for columns, count in mine(shard, keep, allowed, words, fits):
        if len(columns) > len(filters) or longer is not None:
            yield columns, count


def _sums(filters: list, words: int, buckets: int):
    """bucket, keys (their steps) and counts of what a task's shards hold and the filters let through."""

    def run(batches):
        keys, counts, held = [], [], 0

        def flush():
            key, count = _added(keys, counts)
            ends = np.searchsorted(key * np.uint64(buckets) >> np.uint64(HASH_BITS), np.arange(buckets + 1)).tolist()
            rows = [(b, _planes(np.diff(key[x:y], prepend=np.uint64(0))), _planes(count[x:y])) for b, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if y > x]
            columns = zip(*rows, strict=True) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "steps", "counts"])
            keys.clear()
            counts.clear()

        for shard in _decoded(batches):
            h = shard.hash()
            for columns, count in _counted(shard, filters, words):
                keys.append(_key(h, columns))
                counts.append(count)
                held += len(count)
            if held >= HELD_SUMS:
                yield from flush()
                held = 0
        if keys:
            yield from flush()

    return run


def _frequent_keys(least: int):
    """The keys that come to at least so many, of rows sorted by bucket."""

    def run(batches):
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for _, mine_ in groupby(rows, lambda r: r[0]):
            keys, counts, size, base = [], [], 0, 0
            for _, steps, held in mine_:
                keys.append(np.cumsum(_of_planes(steps), dtype=np.uint64))
                counts.append(_of_planes(held))
                size += len(keys[-1])
                if size >= max(HELD_SUMS, 2 * base):
                    keys, counts = ([x] for x in _added(keys, counts))
                    size = base = len(keys[0])
            key, count = _added(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(key[count >= least].astype(np.int64))], names=["key"])

    return run


def frequent(stored: DataFrame, filters: list, words: int, shards_: int, least: int):
    """A broadcast filter that lets all through that is there at least so often: words; pairs of such
    words; phrases of three words and more, all of whose pairs are such. Its size is bounded."""
    buckets = min(max(shards_, BUCKETS[0]), BUCKETS[1])
    sums = arrow_map(stored, _sums(filters, words, buckets), "bucket int, steps binary, counts binary")
    sums = sums.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    keys = cut(arrow_map(sums, _frequent_keys(least), "key long"))
    found = members(keys, keys.count(), lambda batch: mixed(batch.column(0).to_numpy().astype(np.uint64)))
    return stored.sparkSession.sparkContext.broadcast(found.slots)


def _phrases(filters: list, words: int):
    """A row for each word and phrase that passes the filters; and one without a phrase for each
    language, with all its words."""

    def run(batches):
        for shard in _decoded(batches):
            for columns, count in _counted(shard, filters, words):
                yield _batch(*shard.phrases(columns), count)
            total = np.bincount(shard.lang[shard.terms], minlength=len(shard.langs))
            yield _batch(shard.langs, pa.nulls(len(total), pa.string()), total)

    return run


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, words: int = MOST_WORDS):
    """(lang, phrase, a) of all phrases of 1 to so many words with a >= least occurrences, exact, and
    (lang, n), all words of each language.

    A phrase is no more frequent than any part of it. So words, then pairs of frequent words, then
    longer phrases all of whose pairs are frequent are summed by 40 bits of their hash, a few bytes each;
    and then counted exactly, but for those whose sums are too small. What may be frequent is told by set
    filters of bounded size, which let some more through; the exact counts are summed by Spark, map-side
    first, and only they decide."""
    stored = cut(encoded_shards(docs, lang_col, text_col))
    n_shards, filters = stored.where("last").count(), []
    for size in (1, 2, max(3, words)):
        filters.append(frequent(stored, list(filters), size, n_shards, least))
    counted = arrow_map(stored, _phrases(filters, words), "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    counted = cut(counted.where((F.col("a") >= least) | F.col("phrase").isNull()))
    n = counted.where(F.col("phrase").isNull()).select("lang", F.col("a").alias("n"))
    return counted.where(F.col("phrase").isNotNull()), n


def scored(counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """lang, phrase, a, l, r, k and score of the cut that scores least, of each phrase of two words or more."""
    many = counts.where(F.instr("phrase", " ") > 0)
    size = F.size(F.split("phrase", " "))
    cuts = many.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("tail", F.expr("substring(phrase, char_length(head) + 2)"))
    left = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    cuts = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr(f"cast({scale} as decimal(18,0)) * cast(a as decimal(19,0)) div cast(l + r as decimal(20,0))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "best.*")


def not_covered(found: DataFrame, counts: DataFrame, percent: int = COVERED) -> DataFrame:
    """found without the phrases that lie within a longer one with at least so many percent of their count."""
    longer = counts.where(F.size(F.split("phrase", " ")) > 2).withColumn("w", F.split("phrase", " "))
    parts = F.expr(
        "flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))"
    )
    inside = longer.select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("over"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    kept = found.join(inside, ["lang", "phrase"], "left")
    return kept.where(F.col("over").isNull() | (100 * F.col("over") < percent * F.col("a"))).drop("over")


def best_of_each(found: DataFrame, group: str, order: list[Column], unique: str, top: int, name: str = "rank") -> DataFrame:
    """The first rows of each group, numbered from 1. They are sought in shares of the group first, so
    that no task meets more than a share's winners of it."""
    for salts in SALTS:
        share = Window.partitionBy(group, F.pmod(F.xxhash64(unique), F.lit(salts))).orderBy(*order)
        found = found.withColumn(name, F.row_number().over(share)).where(F.col(name) <= top)
    found = found.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return found.where(F.col(name) <= top)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a is the number of a phrase's occurrences within pieces, overlaps included; the phrase is cut
    into two parts (l and r occurrences) where floor(2000000 * a / (l + r)) is least, at the first such
    place. Phrases that mostly stand within a longer one are dropped. Null texts are empty, a null
    language counts as `und`; repeated rows count as often as they are there; texts of any length are
    mined whole; ties of score and count are ordered by the phrase's bytes; an empty table gives no
    rows; other columns are ignored, whatever their names."""
    counts, n = phrase_counts(docs, lang_col, text_col, least)
    found = not_covered(scored(counts), counts)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best_of_each(found, "lang", order, "phrase", top).join(n, "lang")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = collocations(table(spark, sf_dir, "documents"))
    return best.withColumn("rank", F.col("rank").cast("long"))
