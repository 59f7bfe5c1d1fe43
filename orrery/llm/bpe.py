"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, pick, table, worker_store

#: Determinised states and moves, and what paths can do, that a worker keeps; made anew beyond them.
MOST_STATES, MOST_MOVES, MOST_WAYS = 300_000, 700_000, 700_000
#: Units of text (a word with the space before it) that a worker keeps, and their characters.
MOST_UNITS, MOST_CHARS = 200_000, 4_000_000
#: Pieces that go through the transducer together; longer ones go through it by themselves, so
#: many bytes between looks at the number of states.
LANES, LONG_PIECE, CHECK_BYTES = 50_000, 256, 4096
#: Bytes of text split into units at a time, whole texts only.
CHUNK_BYTES = 2 << 20
#: Nodes with no more tokens below them are looked through for one that a path can end in.
FEW_BELOW = 3
#: Tokens that the decoder takes at a time.
DECODE_CHUNK = 1 << 16

NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], stop_at: int = 1) -> list[int]:
    """The defining procedure: merge the adjacent pair of least rank, leftmost first, until none
    merges or so many parts are left. Quadratic; used on single tokens only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > stop_at:
        found = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        least = min(found)
        if least == NEVER:
            break
        i = found.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def first_of(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


class Table:
    """Whole numbers by key (0 or more), for arrays of keys at a time: open addressing with linear
    probes, at most half full."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None) -> None:
        self.keys = np.full(1 << 12, -1, np.int64) if keys is None else keys
        self.values = np.zeros(len(self.keys), np.int32) if values is None else values
        self.used = 0 if keys is None else int((keys >= 0).sum())

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; -1 where there is none."""
        slot = self._slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1).astype(np.int64)
        at = np.flatnonzero((held != keys) & (held >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[at]]
            hit = held == keys[at]
            out[at[hit]] = self.values[slot[at[hit]]]
            at = at[~hit & (held >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys are different from each other, and new."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old, size = self.keys >= 0, len(self.keys)
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            while 2 * len(keys) > size:
                size *= 2
            self.keys, self.values, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0
        self.used += len(keys)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several that come to a slot the last one has it
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values = keys[~placed], values[~placed]
            slot = (slot[~placed] + 1) & (len(self.keys) - 1)


def compile_merges(ranks: dict[bytes, int]) -> dict[str, np.ndarray]:
    """The vocabulary's merges as arrays, a few numbers for each byte of each token: the trie of
    tokens, which pairs make a token together, and the two halves of each token's last merge."""
    most = max(ranks.values(), default=0) + 1
    child: dict[int, int] = {}  # node * 256 + byte: node
    depth, token_at, below = [0], [-1], [[]]
    pairs: dict[int, int] = {}
    length, left, right = np.zeros(most, np.int32), np.full(most, -1, np.int32), np.full(most, -1, np.int32)
    for token, rank in ranks.items():
        node = 0
        for byte in token:
            to = child.get(node << 8 | byte)
            if to is None:
                to = child[node << 8 | byte] = len(depth)
                depth.append(depth[node] + 1)
                token_at.append(-1)
                below.append([])
            node = to
            if len(below[node]) <= FEW_BELOW:
                below[node].append(rank)
        token_at[node] = rank
        length[rank] = len(token)
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = rank
        if len(token) > 1:
            parts = merge_by_rank(token, ranks, 2)
            if len(parts) == 2 and pairs.get(parts[0] << 32 | parts[1]) == rank:
                left[rank], right[rank] = parts
    few = np.full((len(below), FEW_BELOW), -1, np.int32)
    for node, some in enumerate(below):
        few[node, : len(some[:FEW_BELOW])] = some[:FEW_BELOW]
    made = {"length": length, "left": left, "right": right, "depth": np.array(depth, np.int32), "token_at": np.array(token_at, np.int32)}
    made |= {"few": few, "many": np.array([len(some) > FEW_BELOW for some in below])}
    for name, found in (("child", child), ("pairs", pairs)):
        held = Table()
        held.put(np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found)))
        made |= {f"{name}_keys": held.keys, f"{name}_values": held.values}
    return made


class Transducer:
    """Pieces' bytes in, their tokens out.

    A string has one tokenisation, and a sequence of tokens is one exactly if each token and each
    adjacent pair is (merging the bytes of the pair gives the pair). So the merges are a
    nondeterministic transducer that reads a token's bytes along the trie of tokens, emits it at
    its end, and goes on with any token that may follow. It is determinised as bytes come: a state
    is the set of live paths, each with its last token and the trie node that it stands at, oldest
    first; the last of them has ended where the bytes end. What lies before the last boundary that all
    live paths have in common is settled and can be emitted; since a path lives no longer than the
    longest token without a new one, lookahead is bounded.

    Many pieces go through together, a byte of each at a time: their moves are looked up in one
    step, and the moves that aren't known yet are made in one step. States and moves are kept for
    reuse and dropped when there are too many, so memory is bounded as well, and the time is linear
    in the piece, however long it is.
    """

    def __init__(self, merges: dict[str, np.ndarray]) -> None:
        self.length, self.left, self.right, self.depth = (merges[k] for k in ("length", "left", "right", "depth"))
        self.token_at, self.few, self.many = (merges[k] for k in ("token_at", "few", "many"))
        self.child, self.pairs = (Table(merges[f"{k}_keys"], merges[f"{k}_values"]) for k in ("child", "pairs"))
        self.ways = Table()
        self.reset()

    def reset(self) -> None:
        """No states but the start: one path, before any token."""
        self.states, self.items = 0, 0
        self.first, self.size, self.end = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.last, self.node = np.zeros(1 << 13, np.int32), np.zeros(1 << 13, np.int32)
        self.index, self.moves = Table(), Table()
        self.near: dict[int, int] = {}  # the moves of long pieces
        self.start = int(self._states_of(np.ones(1, np.int64), np.full(1, -1), np.zeros(1, np.int64))[0])

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the two stay two when their bytes are merged. Backwards in time: of the parts
        that face each other at the seam the younger is taken apart, and at no time may the two
        have a merge that comes before the one that made them part of something larger. Of merges
        of one rank the left one comes first."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        a_until, b_until = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            together = self.pairs.get(a << 32 | b)
            merge = (together >= 0) & (together < a_until) & (together <= b_until)
            out[at[merge]] = False
            inner_a, inner_b = self.right[a].astype(np.int64), self.left[b].astype(np.int64)
            go = ~merge & ((inner_a >= 0) | (inner_b >= 0))
            at, a, b, a_until, b_until, inner_a, inner_b = (x[go] for x in (at, a, b, a_until, b_until, inner_a, inner_b))
            of_a = (inner_b < 0) | ((inner_a >= 0) & (a > b))
            a_until, b_until = np.where(of_a, a, a_until), np.where(of_a, b_until, b)
            a, b = np.where(of_a, inner_a, a), np.where(of_a, b, inner_b)
        return out

    def _ways_of(self, last: np.ndarray, node: np.ndarray) -> np.ndarray:
        """What a path at node can do: twice (the token that ends there and may follow last, plus
        1; else 0), plus 1 if it can go on to such a token. Paths that can do neither are dropped,
        which lets tokens out sooner and makes states alike."""
        here = self.token_at[node].astype(np.int64)
        asked = np.concatenate([here[:, None], np.where(self.few[node] == here[:, None], -1, self.few[node])], axis=1)
        asked[self.many[node], 1:] = -1
        row, column = np.nonzero(asked >= 0)
        token, before = asked[row, column], last[row]
        fits = (self.length[token] == 1) | (self.left[token] >= 0)  # merges reach it
        check = np.flatnonzero(fits & (before >= 0))
        fits[check] = self._may_follow(before[check], token[check])
        ends, goes_on = np.zeros(len(node), bool), self.many[node].copy()
        ends[row[fits & (column == 0)]] = True
        goes_on[row[fits & (column > 0)]] = True
        return np.where(ends, here + 1, 0) << 1 | goes_on

    def _paths(self, moves: np.ndarray) -> tuple[np.ndarray, ...]:
        """For moves (state * 256 + byte): each path that the byte leads on, by move: the move's
        number, last token, node and ways."""
        state = moves >> 8
        n = self.size[state].astype(np.int64)
        at = runs(self.first[state], n)
        owner = np.repeat(np.arange(len(moves)), n)
        last, node = self.last[at].astype(np.int64), self.child.get(self.node[at].astype(np.int64) << 8 | (moves & 255)[owner])
        on = node >= 0
        owner, last, node = owner[on], last[on], node[on]
        key = (last + 1) << 32 | node
        ways = self.ways.get(key)
        new = np.flatnonzero(ways < 0)
        if len(new):
            if self.ways.used > MOST_WAYS:
                self.ways = Table()
                new = np.arange(len(key))
            _, one, back = np.unique(key[new], return_index=True, return_inverse=True)
            made = self._ways_of(last[new[one]], node[new[one]])
            self.ways.put(key[new[one]], made)
            ways[new] = made[back]
        return owner, last, node, ways

    def _ends(self, moves: int, owner: np.ndarray, ways: np.ndarray) -> np.ndarray:
        """The token that ends with each move's byte."""
        end = np.full(moves, -1, np.int64)
        at = np.flatnonzero(ways > 1)
        end[owner[at]] = (ways[at] >> 1) - 1
        if (end < 0).any():
            raise ValueError("a byte that the vocabulary doesn't hold")
        return end

    def _states_of(self, sizes: np.ndarray, last: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The states with these paths (so many each, one after the other); new ones are added."""
        first = first_of(sizes)
        mixed = ((last + 1).astype(np.uint64) << np.uint64(32)) + node.astype(np.uint64)
        mixed += (np.arange(len(last)) - np.repeat(first, sizes) + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for odd, shift in ((0xFF51AFD7ED558CCD, 29), (0xC4CEB9FE1A85EC53, 32)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(odd)
        key = (np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), first) >> np.uint64(1)).astype(np.int64)
        out, at = np.full(len(sizes), -1, np.int64), np.arange(len(sizes))
        while len(at):
            found = self.index.get(key[at])
            if (found < 0).any():
                new, one = np.unique(key[at[found < 0]], return_index=True)
                self._add(new, at[found < 0][one], first, sizes, last, node)
                found = self.index.get(key[at])
            same = self.size[found] == sizes[at]
            own, held = runs(first[at[same]], sizes[at[same]]), runs(self.first[found[same]], sizes[at[same]])
            equal = (self.last[held] == last[own]) & (self.node[held] == node[own])
            same[same] = np.logical_and.reduceat(equal, first_of(sizes[at[same]])) if same.any() else False
            out[at[same]] = found[same]
            at = at[~same]
            key[at] = (key[at] + 1) & (NEVER - 1)  # another state has this key: the next one
        return out

    def _add(self, keys: np.ndarray, which: np.ndarray, first: np.ndarray, sizes: np.ndarray, last: np.ndarray, node: np.ndarray) -> None:
        at, n, count = runs(first[which], sizes[which]), len(which), int(sizes[which].sum())
        for name, used, more in (("first", self.states, n), ("size", self.states, n), ("end", self.states, n), ("last", self.items, count), ("node", self.items, count)):
            held = getattr(self, name)
            if used + more > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(used + more, held.dtype)]))
        ids = np.arange(self.states, self.states + n)
        self.first[ids] = self.items + first_of(sizes[which])
        self.size[ids] = sizes[which]
        self.last[self.items : self.items + count] = last[at]
        self.node[self.items : self.items + count] = node[at]
        self.end[ids] = last[(first + sizes - 1)[which]]
        self.states, self.items = self.states + n, self.items + count
        self.index.put(keys, ids)

    def _step(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The states after a byte each."""
        key = states << 8 | data
        to = self.moves.get(key)
        new = np.flatnonzero(to < 0)
        if len(new):
            moves, back = np.unique(key[new], return_inverse=True)
            owner, last, node, ways = self._paths(moves)
            end = self._ends(len(moves), owner, ways)
            on = (ways & 1) > 0
            # the paths that go on, and one at the root that has just ended
            owner = np.concatenate([owner[on], np.arange(len(moves))])
            order = np.argsort(owner, kind="stable")
            last = np.concatenate([last[on], end])[order]
            node = np.concatenate([node[on], np.zeros(len(moves), np.int64)])[order]
            made = self._states_of(np.bincount(owner, minlength=len(moves)), last, node)
            self.moves.put(moves, made)
            to[new] = made[back]
        return to

    def _finish(self, states: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The tokens that end pieces with these last bytes; no states are made for them."""
        key = states << 8 | data
        to = self.moves.get(key)
        out = self.end[to].astype(np.int64)
        new = np.flatnonzero(to < 0)
        if len(new):
            moves, back = np.unique(key[new], return_inverse=True)
            owner, _, _, ways = self._paths(moves)
            out[new] = self._ends(len(moves), owner, ways)[back]
        return out

    def _full(self) -> bool:
        return self.states > MOST_STATES or self.moves.used > MOST_MOVES

    def encode(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, one piece after the other, and their number by piece."""
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        counts = np.zeros(len(pieces), np.int64)
        order = sorted((i for i, p in enumerate(pieces) if p), key=lambda i: -len(pieces[i]))
        long = [i for i in order if len(pieces[i]) > LONG_PIECE]
        for i in long:
            found[i] = np.array(list(self.stream([pieces[i]])), np.int64)
            counts[i] = len(found[i])
        made, of = [], []
        for k in range(len(long), len(order), LANES):
            if self._full():
                self.reset()
            lanes = order[k : k + LANES]
            tokens, n = self._together([pieces[i] for i in lanes])
            counts[lanes] = n
            made.append(tokens)
            of += lanes
        tokens = np.concatenate([*made, *(found[i] for i in long), np.zeros(0, np.int64)])
        at = np.zeros(len(pieces), np.int64)  # where each piece's tokens are
        at[[*of, *long]] = first_of(counts[[*of, *long]])
        return tokens[runs(at, counts)], counts

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """encode() of pieces that descend in length."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin, data = first_of(size), np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ended = np.zeros(len(data), np.int64)  # the token that ends with each byte
        state = np.full(len(pieces), self.start)
        for k in range(int(size[0])):
            live, on = (int(np.searchsorted(-size, -k - x)) for x in (0, 1))  # longer than k, than k + 1
            at = begin[:live] + k
            if on:
                state[:on] = self._step(state[:on], data[at[:on]])
                ended[at[:on]] = self.end[state[:on]]
            if live > on:
                ended[at[on:]] = self._finish(state[on:live], data[at[on:]])
        emitted, at = np.zeros(len(data), bool), begin + size - 1
        first = begin
        while len(at):  # from each piece's end back over its tokens
            emitted[at] = True
            at = at - self.length[ended[at]]
            on = at >= first
            at, first = at[on], first[on]
        return ended[emitted], np.add.reduceat(emitted, begin)

    def stream(self, parts: Sequence[bytes]) -> Iterator[int]:
        """The tokens of one piece whose bytes come in parts, each as soon as it is settled."""
        state, ended = self.start, []  # ended: for the bytes from the last token emitted on
        near, end = self.near, self.end

        def settled(upto: int) -> list[int]:
            out = []
            while upto > 0:
                out.append(ended[upto - 1])
                upto -= int(self.length[out[-1]])
            return out[::-1]

        for part in parts:
            for begin in range(0, len(part), CHECK_BYTES):
                if self._full() or len(near) > MOST_MOVES:  # go on from the state that is reached
                    at = runs(self.first[state : state + 1], self.size[state : state + 1])
                    last, node = self.last[at].astype(np.int64), self.node[at].astype(np.int64)
                    self.reset()
                    state = int(self._states_of(np.array([len(at)]), last, node)[0])
                    near, end = self.near, self.end
                for byte in part[begin : begin + CHECK_BYTES]:
                    key = state << 8 | byte
                    state = near.get(key)
                    if state is None:
                        state = near[key] = int(self._step(np.array([key >> 8]), np.array([byte]))[0])
                        end = self.end
                    ended.append(int(end[state]))
                live = self.node[runs(self.first[state : state + 1], self.size[state : state + 1])]
                ends = set((len(ended) - self.depth[live]).tolist())  # of the paths' last tokens
                while len(ends) > 1:
                    latest = max(ends)
                    ends.remove(latest)
                    ends.add(latest - int(self.length[ended[latest - 1]]))
                (done,) = ends
                yield from settled(done)
                del ended[:done]
        yield from settled(len(ended))


class Utf8Machine:
    """UTF-8 by states, over whole tokens: 0 between characters, else what must follow."""

    #: Bytes still to come, and the range of the next one.
    STATES = ((0, 0, 0), (1, 0x80, 0xBF), (2, 0x80, 0xBF), (2, 0xA0, 0xBF), (2, 0x80, 0x9F), (3, 0x80, 0xBF), (3, 0x90, 0xBF), (3, 0x80, 0x8F))

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.moves: dict[tuple[int, int], int] = {}
        self.texts = [b""] * (max(bytes_of, default=0) + 1)
        for token, text in bytes_of.items():
            self.texts[token] = text
        self.whole = np.array([text.isascii() or self.run(0, text) == 0 for text in self.texts], dtype=bool)

    def step(self, state: int, byte: int) -> int:
        """The state after byte; -1 if it can't come here."""
        if state == 0:
            if byte < 0x80:
                return 0
            lead = {0xE0: 3, 0xED: 4, 0xF0: 6, 0xF4: 7}.get(byte)
            return lead or (1 if 0xC2 <= byte <= 0xDF else 2 if 0xE1 <= byte <= 0xEF else 5 if 0xF1 <= byte <= 0xF3 else -1)
        left, least, most = self.STATES[state]
        return (0, 1, 2)[left - 1] if least <= byte <= most else -1

    def run(self, state: int, text: bytes) -> int:
        for byte in text:
            state = self.step(state, byte)
            if state < 0:
                return -1
        return state

    def token(self, state: int, token: int) -> int:
        known = self.moves.get((state, token))
        if known is None:
            known = self.moves[state, token] = self.run(state, self.texts[token])
        return known


class StreamDecoder:
    """Text of a stream of tokens, as it comes: a character whose bytes are spread over tokens is
    given when its last byte has come; bytes that are not UTF-8 become U+FFFD."""

    def __init__(self, machine: Utf8Machine) -> None:
        self.machine, self.state, self.held = machine, 0, b""

    def feed(self, tokens: np.ndarray) -> str:
        """The text that is complete with these tokens. What a character's bytes are spread over
        begins after the last token that is whole by itself, so the machine runs from there."""
        machine, n = self.machine, len(tokens)
        if not n:
            return ""
        whole = machine.whole[tokens]
        tail = n if whole[-1] else int(np.flatnonzero(whole)[-1]) + 1 if whole.any() else 0
        state = 0 if tail else self.state
        complete = tail if state == 0 else -1
        for k in range(tail, n):
            state = max(0, machine.token(state, int(tokens[k])))
            if state == 0:
                complete = k + 1
        self.state = state
        texts = machine.texts
        if complete < 0:  # the character began in an earlier feed and goes on
            self.held += b"".join([texts[t] for t in tokens.tolist()])
            return ""
        ready = self.held + b"".join([texts[t] for t in tokens[:complete].tolist()])
        self.held = b"".join([texts[t] for t in tokens[complete:].tolist()])
        return ready.decode("utf-8", "replace")

    def close(self) -> str:
        held, self.held, self.state = self.held, b"", 0
        return held.decode("utf-8", "replace")


#: Characters on whose class Python's own engine and the Unicode properties agree, and the same
#: classes in its terms; texts of these only (most) are split by it, at half the time.
ODD = re.compile("[^\\t-\\r -~\\u00a1-\\u00a9\\u00ab-\\u00b1\\u00b4\\u00b6-\\u00b8\\u00bb\\u00bf-\\u024f\\u2010-\\u2027\\u20ac]")
PLAIN = ((r"\p{L}\p{N}", r"\w"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"[^\s\w]", r"(?:[^\s\w]|_)"))
#: Where a pattern that lets one space lead a piece begins a piece whatever surrounds it.
UNIT_START = re.compile(r"(?<=\S)(?= )")


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], merges: dict[str, np.ndarray], pattern: str) -> None:
        self.ranks = ranks
        self.by_units = r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|" in pattern
        # the library's white space is the Unicode property
        self.pieces = regex.compile(
            pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
        )
        for old, new in PLAIN:
            pattern = pattern.replace(old, new)
        self.plain = re.compile(pattern) if "\\p" not in pattern else None
        self.transducer = Transducer(merges)
        self._forget()

    def _forget(self) -> None:
        self.units: dict[str, int] = {}
        self.chars = 0
        self.tokens, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _split(self, text: str) -> list[str]:
        return (self.pieces if self.plain is None or ODD.search(text) else self.plain).findall(text)

    def _learn(self, units: list[str]) -> None:
        """Split new units into pieces and encode the different pieces together."""
        split = [self._split(u) for u in units]
        number: dict[str, int] = {}
        at = np.fromiter((number.setdefault(p, len(number)) for pieces in split for p in pieces), np.int64)
        raw = [p.encode() for p in number]
        # a piece that is a token is it, whether merges reach it or not
        whole = np.fromiter((self.ranks.get(p, -1) for p in raw), np.int64, len(raw))
        tokens, counts = self.transducer.encode([p if t < 0 else b"" for p, t in zip(raw, whole.tolist(), strict=True)])
        made = np.zeros(len(tokens) + int((whole >= 0).sum()), np.uint32)
        counts[whole >= 0] = 1
        first = first_of(counts)
        is_whole = np.zeros(len(made), bool)
        is_whole[first[whole >= 0]] = True
        made[is_whole], made[~is_whole] = whole[whole >= 0], tokens
        pieces = np.fromiter(map(len, split), np.int64, len(split))
        of_unit = np.concatenate([[0], np.cumsum(counts[at])])[np.concatenate([[0], np.cumsum(pieces)])]
        self.first = np.concatenate([self.first, len(self.tokens) + of_unit[:-1]])
        self.count = np.concatenate([self.count, np.diff(of_unit)])
        self.tokens = np.concatenate([self.tokens, made[runs(first[at], counts[at])]])

    def _numbers(self, units: list[str]) -> list[int]:
        """Each unit's number among those that are kept; new ones are added."""
        known, size = self.units, len(self.units)
        at = [known.setdefault(u, len(known)) for u in units]
        if len(known) > size:
            new = list(known)[size:] if size < len(units) else list(itertools.islice(reversed(known), len(known) - size))[::-1]
            self.chars += sum(map(len, new))
            self._learn(new)
        return at

    def _units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the texts' units, one text after the other, and how many each has.

        A space after another character always begins a piece, so texts are taken apart there and
        each different unit is split and encoded once. A word that ends in white space, or is
        empty, has a space after it that begins none; texts with such are split by themselves."""
        rows = len(texts)
        if not self.by_units:
            return np.array(self._numbers(texts.to_pylist()), np.int64), np.ones(rows, np.int64)
        split = pc.split_pattern(texts, " ")
        counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
        first = first_of(counts)
        words = split.flatten().dictionary_encode()
        at, different = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        open_ = np.fromiter((not w or w[-1].isspace() for w in different), bool, len(different))[at]
        last, heads = first + counts - 1, at[first]
        open_[last] = False
        open_[first] &= np.fromiter((bool(different[h]) for h in heads), bool, rows)
        odd = np.logical_or.reduceat(open_, first)
        plain = np.repeat(~odd, counts)
        plain[first] = False  # the first word has no space before it
        used = np.flatnonzero(np.bincount(at[plain], minlength=len(different)))
        number = np.zeros(len(different), np.int64)
        number[used] = self._numbers([" " + different[k] for k in used.tolist()])
        out = number[at]
        out[first] = self._numbers([different[h] if not o else "" for h, o in zip(heads.tolist(), odd.tolist(), strict=True)])
        if not odd.any():
            return out, counts
        parts, begin = [], 0
        for k in np.flatnonzero(odd).tolist():
            parts.append(out[begin : first[k]])
            parts.append(np.array(self._numbers(UNIT_START.split(texts[k].as_py())), np.int64))
            begin = first[k] + counts[k]
            counts[k] = len(parts[-1])
        return np.concatenate([*parts, out[begin:]]), counts

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts (strings, no nulls), one text after the other, and their number
        by text."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        chunk = np.cumsum(size) // CHUNK_BYTES
        made, numbers = [], []
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(chunk)) + 1):
            if not len(part):
                continue
            if len(self.units) > MOST_UNITS or self.chars > MOST_CHARS:
                self._forget()
            units, counts = self._units(texts.slice(int(part[0]), len(part)))
            of_unit = self.count[units]
            made.append(self.tokens[runs(self.first[units], of_unit)])
            numbers.append(np.add.reduceat(np.concatenate([of_unit, [0]]), first_of(counts)) * (counts > 0))
        return np.concatenate([*made, np.zeros(0, np.uint32)]), np.concatenate([*numbers, np.zeros(0, np.int64)])

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.large_string()))[0].tolist()


def decode(machine: Utf8Machine, tokens: np.ndarray, chunk: int = DECODE_CHUNK) -> Iterator[str]:
    stream = StreamDecoder(machine)
    for k in range(0, len(tokens), chunk):
        yield stream.feed(tokens[k : k + chunk])
    yield stream.close()


def _of_worker(kind: type, key: str, make):
    """What an earlier task of this worker made under the same key, with all that it has learnt
    since, or a new one; the last of each kind is kept."""
    store = worker_store()
    if store.get(kind.__name__, ("",))[0] != key:
        store[kind.__name__] = key, make()
    return store[kind.__name__][1]


class Vocabulary:
    """A vocabulary's ranks and merges, compiled and broadcast (some hundred bytes a token) by the
    driver, which alone reads the file; workers build their machines from them once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = "") -> None:
        ranks = read_ranks(path)
        text = pattern + "".join(f" {token.hex()}:{rank}" for token, rank in ranks.items())
        self.key, self.pattern = hashlib.sha256(text.encode()).hexdigest(), pattern
        self.held = spark.sparkContext.broadcast((ranks, compile_merges(ranks) if pattern else None))

    def tokenizer(self) -> Tokenizer:
        return _of_worker(Tokenizer, self.key, lambda: Tokenizer(*self.held.value, self.pattern))

    def machine(self) -> Utf8Machine:
        return _of_worker(Utf8Machine, self.key, lambda: Utf8Machine({rank: token for token, rank in self.held.value[0].items()}))


def _encoded(vocabulary: Vocabulary, texts: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    tokens, counts = vocabulary.tokenizer().encode_all(texts)
    ends = np.cumsum(counts)
    raw = tokens.astype("<u4", copy=False)
    offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
    if len(texts) and 4 * int(ends[-1]) >= 1 << 31:
        raise ValueError("a batch of texts has over 2^31 bytes of tokens")
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), np.split(raw, ends[:-1])


def _decoded(vocabulary: Vocabulary, rows: Sequence[np.ndarray]) -> pa.Array:
    machine = vocabulary.machine()
    return pa.array(["".join(decode(machine, tokens)) for tokens in rows], pa.string())


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", name: str = "tokens") -> DataFrame:
    """docs with the tokens of each text as little-endian unsigned 32-bit integers in one binary
    column. Every match of pattern is encoded by itself; no special tokens. A null or empty text
    has no tokens. Rows are independent: repeated ones repeat their tokens, an empty table gives no
    rows. Other columns pass through, but for one that already has the new name. path is read on
    the driver."""
    vocabulary = Vocabulary(docs.sparkSession, path, pattern)
    return append_columns(docs, [text_col], lambda texts: [_encoded(vocabulary, texts)[0]], [T.StructField(name, T.BinaryType())], keep_store=True)


def decode_tokens(df: DataFrame, path: str, tokens_col: str = "tokens", name: str = "decoded") -> DataFrame:
    """df with the text of each row's tokens; null tokens count as none. Rows are independent, an
    empty table gives no rows; other columns pass through, but for one that already has the new
    name."""
    vocabulary = Vocabulary(df.sparkSession, path)

    def run(column: pa.Array) -> list[pa.Array]:
        return [_decoded(vocabulary, [np.frombuffer(raw or b"", dtype="<u4") for raw in column.to_pylist()])]

    return append_columns(df, [tokens_col], run, [T.StructField(name, T.StringType())], keep_store=True)


def code_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with tokens and decoded: encode_texts() and decode_tokens() in one pass over the texts."""
    vocabulary = Vocabulary(docs.sparkSession, path, pattern)

    def run(texts: pa.Array) -> list[pa.Array]:
        tokens, rows = _encoded(vocabulary, texts)
        return [tokens, _decoded(vocabulary, rows)]

    fields = [T.StructField("tokens", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return append_columns(docs, [text_col], run, fields, keep_store=True)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, read off the operator's outputs.
    Null and empty texts have no tokens; repeated rows are repeated, extra columns ignored."""
    return code_texts(pick(docs, doc_id=id_col, text=text_col), path, pattern).select(
        "doc_id",
        F.expr("octet_length(tokens) div 4").cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), *vocabulary())
