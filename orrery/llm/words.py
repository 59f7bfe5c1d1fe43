"""Words of many texts at a time, as numbers into a dictionary; hashes and set filters over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Bytes of text that are gathered into one shard (a single longer text is a shard of its own), and
#: bytes that are split at a time.
SHARD_BYTES = 5 << 20
WINDOW_BYTES = 1 << 20
#: Bits of a set filter: so many for each member, within bounds (2^27 bits are 16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 27

WORD, GAP, BREAK = 0, 1, 2
_LOWER = bytes(range(256)).lower()  # A-Z only
_PLACES = np.random.default_rng(20261103).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def byte_classes(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """For each byte whether it belongs to a word, lies between words, or ends a piece as well."""
    made = np.full(256, WORD, np.uint8)
    made[list(gaps)], made[list(breaks)] = GAP, BREAK
    return made


def shards(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.Table]:
    """The batches of a task, gathered into tables with about SHARD_BYTES in the given column."""
    most = SHARD_BYTES if most is None else most
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


@dataclass
class Words:
    """word[i] is the number in dictionary of the i-th word, text[i] the row it is in, and first[i]
    whether a piece begins with it."""

    dictionary: pa.Array
    word: np.ndarray
    text: np.ndarray
    first: np.ndarray


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows one after the other, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def split_words(column: pa.Array | pa.ChunkedArray, classes: np.ndarray) -> Words:
    """The words of whole texts, A-Z lower-cased. Any length is split, a window at a time; a word
    longer than a window widens it. Equal words are told apart by their bytes, not by a hash."""
    data, starts = flat_bytes(column)
    table = classes.tobytes()
    edge = np.unique(starts)
    words, texts, firsts = [], [], []
    lo, last_text, open_break = 0, -1, True
    while lo < len(data):
        hi = min(lo + WINDOW_BYTES, len(data))
        while hi < len(data) and classes[data[hi]] == WORD:  # to the end of a word
            ahead = np.flatnonzero(classes[data[hi : hi + 4096]] != WORD)
            hi = hi + int(ahead[0]) if len(ahead) else min(hi + 4096, len(data))
        raw = data[lo:hi].tobytes()
        part, kind = (np.frombuffer(raw.translate(t), np.uint8) for t in (_LOWER, table))
        inside = kind == WORD
        cut = edge[np.searchsorted(edge, lo) : np.searchsorted(edge, hi)] - lo
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[cut] = inside[cut]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        before = cut[cut > 0] - 1
        ends[before] = inside[before]
        at, till = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        text = (np.searchsorted(starts, at + lo, "right") - 1).astype(np.int32)
        pieces = np.cumsum(kind == BREAK, dtype=np.int32)
        if len(at):
            first = np.empty(len(at), bool)
            first[1:] = (pieces[at[1:]] != pieces[at[:-1]]) | (text[1:] != text[:-1])
            first[0] = open_break or pieces[at[0]] > 0 or text[0] != last_text
            last_text, open_break = int(text[-1]), bool(pieces[-1] > pieces[at[-1]])
            offsets = np.concatenate([[0], np.cumsum(till - at)]).astype(np.int32)
            words.append(pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(part[inside])]))
            texts.append(text)
            firsts.append(first)
        elif len(pieces):
            open_break |= bool(pieces[-1])
        lo = hi
    coded = pa.chunked_array(words or [pa.array([], pa.binary())], pa.binary()).dictionary_encode()  # one dictionary for all
    number = np.concatenate([c.indices.to_numpy() for c in coded.chunks]) if words else np.zeros(0, np.int32)
    dictionary = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.binary())
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Words(dictionary, number, join(texts, np.int32), join(firsts, bool))


def coded_column(column: pa.Array | pa.ChunkedArray, null: str) -> tuple[pa.Array, np.ndarray]:
    """The different values of a string column (null counts as given) and the number of each row's."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.cast(pa.string()).fill_null(null).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def by_group(group: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, word) pairs numbered in order: each pair's group and word, and the number of each row's."""
    pair, number = np.unique(group.astype(np.int64) * max(words, 1) + word, return_inverse=True)
    return pair // max(words, 1), pair % max(words, 1), number


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """64 bits of each value, for filters only: unequal values may have equal ones."""
    data, starts = flat_bytes(values)
    length = np.diff(starts)
    out = np.zeros(len(length), np.uint64)
    full = length > 0
    if full.any():
        place = np.arange(len(data)) - np.repeat(starts[:-1], length)
        out[full] = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _PLACES[place & 255], starts[:-1][full])
    return mixed(out + length.astype(np.uint64))


def in_group(group_hash: np.ndarray, word_hash: np.ndarray) -> np.ndarray:
    return mixed(group_hash * np.uint64(0x9E3779B97F4A7C15) + word_hash)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two words one after the other, of theirs."""
    return mixed(a * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xA0761D6478BD642F))


class Members:
    """A Bloom filter of 2^k bits. It lets through every member, and some others, which are counted
    exactly later: it saves work and decides nothing."""

    def __init__(self, slots: np.ndarray) -> None:
        self.slots, self.mask = slots, np.uint64(64 * len(slots) - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for bit in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            found &= (self.slots[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return found


def members(df: DataFrame, count: int, hashed) -> Members:
    """The filter of df's rows (there are count); hashed(batch) gives each one's 64 bits. Tasks set the
    bits; the driver gets the filter alone, MOST_BITS at most whatever the number of rows."""
    k = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * count - 1).bit_length() if count else 0))
    mask = np.uint64((1 << k) - 1)

    def run(batches):
        for batch in batches:
            h = hashed(batch)
            bit = np.concatenate([h & mask, (h >> np.uint64(32)) & mask])
            slot, at = np.unique(bit >> np.uint64(6), return_inverse=True)
            held = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(held, at, np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(held.view(np.int64))], names=["slot", "bits"])

    made = arrow_map(df, run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots = np.zeros(1 << (k - 6), np.uint64)
    if made.num_rows:
        slots[made["slot"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
    return Members(slots)


def joined(parts: list[pa.Array]) -> pa.Array:
    """Words one after the other with a space between, as strings."""
    if len(parts) == 1:
        return parts[0].cast(pa.string())
    return pc.binary_join_element_wise(*[p.cast(pa.string()) for p in parts], " ")
