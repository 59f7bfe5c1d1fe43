"""Personal data: rules for the common forms, and a character BiLSTM with a CRF for others."""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fit_in_task, least_by_hash, pick, replace_column, table

#: Kinds of spans; the rules know the first four, the network adds to all.
KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = len(KINDS) + 1  # 0: none
#: The network: symbols (ASCII, four classes of others, the end of a text), embedding and state sizes.
SYMBOLS, PAD, EMBEDDING, STATE = 133, 132, 16, 16
#: Texts are cut into windows that share OVERLAP characters.
WINDOW, OVERLAP = 256, 32
#: Windows that the network reads at a time, and characters of whole texts taken together.
BLOCK, SCREEN_CHARS = 512, 1 << 20
#: Steps that one piece of the search over tags has at most, and pieces searched side by side.
PIECE, PIECES = 64, 4096
#: Weights of the screen by n-gram, and the share of training spans that may fall below its bar.
SCREEN_BITS, SCREEN_LOSS = 17, 0.001
#: The bound of the training sample: texts, and characters of each.
TRAIN_TEXTS, TRAIN_CHARS = 300, 4000
STEPS, BATCH, TRAIN_WINDOW, TRAIN_WINDOWS = 1200, 64, 80, 8000

Span = tuple[str, int, int]

_EMAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What stands for a secret in training texts that hold some: a long word of letters and digits.
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{20,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def small_part(digits: str) -> bool:
    """Whether a part of an address, of any length, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's rule that pass its test, by kind and start.
    All four take time linear in the text: emails are found from their @ and digits by runs."""
    found: list[Span] = []
    end = 0
    if "@" in text:
        at = _EMAIL_END.search(text)
        while at:
            start = at.start()
            while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
                start -= 1
            if start < at.start():
                end = at.end()
                found.append(("email", start, end))
                at = _EMAIL_END.search(text, end)
            else:
                at = _EMAIL_END.search(text, at.start() + 1)
    if not _DIGITS.search(text):
        return found
    for chain in _CHAIN.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for k in range(0, len(parts) - len(parts) % 4, 4):
            four = parts[k : k + 4]
            length = sum(map(len, four)) + 3
            if all(small_part(p) for p in four):
                found.append(("ip", at, at + length))
            at += length + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found

_CLASSES = np.full(0x3001, 131, np.uint8)
for _to, _class in ((0x3000, 130), (0x2000, 129), (0x250, 128)):
    _CLASSES[:_to] = _class
_CLASSES[:128] = np.arange(128)


def symbols(text: str) -> np.ndarray:
    """Each character's input symbol: ASCII as it is, others by class."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    return _CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x3000)]


class Screen:
    """A linear model of single characters over hashed n-grams of 3 and 5 around them, digits and
    cases alike: does a character lie in a span? It is trained on the network's own windows; its
    bar is so low that, of the spans there, nearly all have a character above it. Windows without
    such a character hold few spans that the network would find, but may hold some, so it is off
    unless it is asked for; no query asks."""

    FOLD = np.arange(256, dtype=np.uint32)
    FOLD[ord("0") : ord("9") + 1] = ord("0")
    FOLD[ord("A") : ord("Z") + 1] += 32
    MIX = np.random.default_rng(77).integers(1, 1 << 32, 6, dtype=np.uint32) | np.uint32(1)

    def __init__(self, weights: np.ndarray, bar: float) -> None:
        self.weights, self.bar = weights, np.float32(bar)

    @classmethod
    def off(cls) -> Screen:
        """The screen that clears nothing."""
        return cls(np.zeros((2, 1 << SCREEN_BITS), np.float32), -np.inf)

    @classmethod
    def grams(cls, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the 3-gram and the 5-gram around each place of the last axis."""
        x = cls.FOLD[ids] + np.uint32(1)
        wide = np.concatenate([np.zeros((*x.shape[:-1], 2), np.uint32), x, np.zeros((*x.shape[:-1], 2), np.uint32)], axis=-1)
        n, at = x.shape[-1], lambda k: wide[..., k : k + n]
        three = at(1) * cls.MIX[1] + at(2) * cls.MIX[2] + at(3) * cls.MIX[3]
        five = (three ^ (three >> np.uint32(13))) * cls.MIX[5] + at(0) * cls.MIX[0] + at(4) * cls.MIX[4]
        shift = np.uint32(32 - SCREEN_BITS)
        return (three ^ (three >> np.uint32(15))) * cls.MIX[0] >> shift, (five ^ (five >> np.uint32(15))) * cls.MIX[2] >> shift

    def score(self, ids: np.ndarray) -> np.ndarray:
        three, five = self.grams(ids)
        return self.weights[0].take(three) + self.weights[1].take(five)

    @classmethod
    def fit(cls, windows: np.ndarray, tags: np.ndarray, clean: np.ndarray, rounds: int = 60) -> Screen:
        """Adam on all characters of (window, time) examples and of texts in which nothing is
        labelled; spans and others weigh the same. Equal pairs of n-grams are one example."""
        made = [np.concatenate([g.ravel(), c]) for g, c in zip(cls.grams(windows), cls.grams(clean), strict=True)]
        y = np.concatenate([(tags > 0).ravel(), np.zeros(len(clean), bool)])
        key, times = np.unique((made[0].astype(np.int64) << 33) | (made[1].astype(np.int64) << 1) | y, return_counts=True)
        y = (key & 1).astype(np.float32)
        buckets = [key >> 33, (key >> 1) & ((1 << SCREEN_BITS) - 1)]
        balance = times * np.where(y > 0, 0.5 / max(1.0, times @ y), 0.5 / max(1.0, times @ (1 - y)))
        weights, m, v = (np.zeros((2, 1 << SCREEN_BITS)) for _ in range(3))
        for n in range(1, rounds + 1):
            z = weights[0][buckets[0]] + weights[1][buckets[1]]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
            grad = np.stack([np.bincount(b, weights=error, minlength=1 << SCREEN_BITS) for b in buckets]) + 1e-9 * weights
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            weights -= 0.3 * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-9)
        made = cls(weights.astype(np.float32), 0)
        # the best character of each span that its window holds whole
        wide = np.pad(tags, ((0, 0), (1, 1)), constant_values=-1).ravel()
        starts = np.flatnonzero(np.diff(wide, prepend=-1))
        ends = np.append(starts[1:], len(wide) - 1)
        best = np.maximum.reduceat(np.pad(made.score(windows), ((0, 0), (1, 1))).ravel(), starts)
        whole = (wide[starts] > 0) & (wide[starts - 1] >= 0) & (wide[ends] >= 0)
        if whole.any():
            made.bar = np.float32(np.quantile(best[whole], SCREEN_LOSS, method="lower"))
        return made


class Network:
    """Embeddings, a forward and a backward LSTM (run side by side), a linear layer to the tags'
    scores, and CRF transitions. Arrays are (time, direction, batch, feature). Gates are hard
    sigmoids, 0.5 + SLOPE * z cut to 0 and 1, and values are bent by z / (1 + |z|), which take a
    tenth of the time of tanh; training is longer for it."""

    SLOPE = 0.2

    def __init__(self, seed: int = 5, dtype: type = np.float32) -> None:
        rng = np.random.default_rng(seed)
        s = STATE
        self.p: dict[str, np.ndarray] = {
            "emb": rng.normal(0, 0.3, (SYMBOLS, EMBEDDING)),
            "x": rng.normal(0, EMBEDDING**-0.5, (2, EMBEDDING, 4 * s)),
            "h": rng.normal(0, s**-0.5, (2, s, 4 * s)),
            "b": np.zeros((2, 1, 4 * s)),
            "out": rng.normal(0, 0.3, (2 * s, TAGS)),
            "out_b": np.zeros(TAGS),
            "move": np.zeros((TAGS, TAGS)),
        }
        self.p["b"][:, :, s : 2 * s] = 1.0  # remember at first
        self.p["out_b"][0] = 2.0
        self.p = {k: v.astype(dtype) for k, v in self.p.items()}

    @staticmethod
    def _bend(z: np.ndarray, out: np.ndarray) -> np.ndarray:
        """z / (1 + |z|)."""
        np.abs(z, out=out)
        out += 1
        return np.divide(z, out, out=out)

    @classmethod
    def _gates(cls, g: np.ndarray) -> np.ndarray:
        """In, keep, out: hard sigmoids; new: bent. In place."""
        first, new = g[..., : 3 * STATE], g[..., 3 * STATE :]
        first *= cls.SLOPE
        first += 0.5
        np.clip(first, 0, 1, out=first)
        new[...] = cls._bend(new, np.empty_like(new))
        return g

    def _lstm(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        s, steps, batch = STATE, len(x), x.shape[2]
        gates = np.matmul(x, self.p["x"]) + self.p["b"]
        cells, states, bent = (np.zeros((steps + 1, 2, batch, s), x.dtype) for _ in range(3))
        for t in range(steps):
            g = gates[t]
            g += states[t] @ self.p["h"]
            self._gates(g)
            np.multiply(g[..., s : 2 * s], cells[t], out=cells[t + 1])
            cells[t + 1] += g[..., :s] * g[..., 3 * s :]
            self._bend(cells[t + 1], bent[t + 1])
            np.multiply(g[..., 2 * s : 3 * s], bent[t + 1], out=states[t + 1])
        return states[1:], (x, gates, cells, states, bent)

    def _lstm_back(self, kept: tuple, d_states: np.ndarray, grad: dict) -> np.ndarray:
        x, gates, cells, states, bent = kept
        s, steps, back = STATE, len(x), self.p["h"].transpose(0, 2, 1)
        dz = np.empty_like(gates)
        rising = (gates[..., : 3 * s] > 0) & (gates[..., : 3 * s] < 1)
        slope = np.concatenate([self.SLOPE * rising.astype(gates.dtype), (1 - np.abs(gates[..., 3 * s :])) ** 2], axis=-1)
        through = gates[..., 2 * s : 3 * s] * (1 - np.abs(bent[1:])) ** 2
        dh, dc = np.zeros_like(states[0]), np.zeros_like(states[0])
        for t in reversed(range(steps)):
            dh += d_states[t]
            dc += dh * through[t]
            g, d = gates[t], dz[t]
            np.multiply(dc, g[..., 3 * s :], out=d[..., :s])
            np.multiply(dc, cells[t], out=d[..., s : 2 * s])
            np.multiply(dh, bent[t + 1], out=d[..., 2 * s : 3 * s])
            np.multiply(dc, g[..., :s], out=d[..., 3 * s :])
            d *= slope[t]
            dc *= g[..., s : 2 * s]
            dh = d @ back
        flat = dz.transpose(1, 0, 2, 3).reshape(2, -1, 4 * s)
        grad["x"] = x.transpose(1, 3, 0, 2).reshape(2, EMBEDDING, -1) @ flat
        grad["h"] = states[:-1].transpose(1, 3, 0, 2).reshape(2, s, -1) @ flat
        grad["b"] = flat.sum(axis=1, keepdims=True)
        return np.matmul(dz, self.p["x"].transpose(0, 2, 1))

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags (time, batch) under the CRF, and its gradient."""
        steps, batch = ids.shape
        x = self.p["emb"][ids]
        states, kept = self._lstm(np.stack([x, x[::-1]], axis=1))
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        score = both @ self.p["out"] + self.p["out_b"]
        # forward and backward sums, scaled at each step
        top = score.max(axis=2, keepdims=True)
        e, move = np.exp(score - top), np.exp(self.p["move"])
        left, right, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, batch, 1), e.dtype)
        for t in range(steps):
            now = e[t] if t == 0 else (left[t - 1] @ move) * e[t]
            scale[t] = now.sum(axis=1, keepdims=True)
            left[t] = now / scale[t]
        for t in reversed(range(steps - 1)):
            right[t] = (right[t + 1] * e[t + 1] / scale[t + 1]) @ move.T
        rows, cols = np.indices(ids.shape)
        gold = score[rows, cols, tags].sum(axis=0) + self.p["move"][tags[:-1], tags[1:]].sum(axis=0)
        loss = float((np.log(scale).sum(axis=(0, 2)) + top.sum(axis=(0, 2)) - gold).mean())
        d_score = left * right
        d_score[rows, cols, tags] -= 1
        ahead = right[1:] * e[1:] / scale[1:]
        d_move = move * (left[:-1].reshape(-1, TAGS).T @ ahead.reshape(-1, TAGS))
        np.subtract.at(d_move, (tags[:-1], tags[1:]), 1)
        d_score /= batch
        grad = {"move": d_move / batch, "out": both.reshape(-1, 2 * STATE).T @ d_score.reshape(-1, TAGS), "out_b": d_score.sum(axis=(0, 1))}
        d_both = d_score @ self.p["out"].T
        dx = self._lstm_back(kept, np.stack([d_both[..., :STATE], d_both[::-1, :, STATE:]], axis=1), grad)
        dx = dx[:, 0] + dx[::-1, 1]
        grad["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grad["emb"], ids, dx)
        return loss, grad

    def fit(self, windows: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 6) -> float:
        """Adam on random batches of (window, time) examples; the last losses' mean."""
        rng = np.random.default_rng(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        losses = []
        for n in range(1, steps + 1):
            at = rng.integers(0, len(windows), batch)
            loss, grad = self.step(windows[at].T, tags[at].T)
            losses.append(loss)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = 0.02 * min(1.0, 5.0 / max(size, 1e-9)) * (1 - 0.95 * n / steps)
            for k, g in grad.items():
                m, v = moments[k]
                m = 0.9 * m + 0.1 * g
                v = 0.99 * v + 0.01 * g * g
                moments[k] = m, v
                self.p[k] = (self.p[k] - rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)).astype(g.dtype)
        return float(np.mean(losses[-20:]))

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """The tags' scores (time, window, tag) of windows (time, window). The gates' slope and
        middle are in the weights, so that a gate is one cut."""
        steps, n = ids.shape
        s, dtype = STATE, self.p["h"].dtype
        gate = np.arange(4 * s) < 3 * s
        slope, middle = np.where(gate, self.SLOPE, 1).astype(dtype), np.where(gate, 0.5, 0).astype(dtype)
        by_symbol = (np.matmul(self.p["emb"], self.p["x"]) + self.p["b"]) * slope + middle
        into, out = self.p["h"] * slope, self.p["out"].reshape(2, s, TAGS)
        h, c, bent = (np.zeros((2, n, s), dtype) for _ in range(3))
        g, given, both = np.empty((2, n, 4 * s), dtype), np.empty((2, n, 4 * s), dtype), np.empty((2, steps, n, TAGS), dtype)
        first, keep, shown, new = g[..., :s], g[..., s : 2 * s], g[..., 2 * s : 3 * s], g[..., 3 * s :]
        gates = g[..., : 3 * s]
        for t in range(steps):
            for k, at in ((0, t), (1, steps - 1 - t)):
                np.take(by_symbol[k], ids[at], axis=0, out=given[k], mode="clip")
            np.matmul(h, into, out=g)
            g += given
            np.clip(gates, 0, 1, out=gates)
            self._bend(new, bent)
            bent *= first
            c *= keep
            c += bent
            self._bend(c, bent)
            np.multiply(bent, shown, out=h)
            np.matmul(h[0], out[0], out=both[0, t])
            np.matmul(h[1], out[1], out=both[1, steps - 1 - t])
        both[0] += both[1]
        both[0] += self.p["out_b"]
        return both[0]


class Tagger:
    """The trained network (and a screen, off by default), and the tags of whole texts under it.

    The network reads every window of every text (with a screen, those that it doesn't clear), and
    where windows overlap their scores are averaged, each weighing the more the farther a
    character is from its ends. One search over the text then finds the best sequence of tags, from
    none to none."""

    def __init__(self, network: Network, screen: Screen) -> None:
        self.network, self.screen = network, screen

    def numbers(self) -> dict[str, np.ndarray]:
        screen = {} if np.isneginf(self.screen.bar) else {"screen": self.screen.weights, "bar": np.array(self.screen.bar)}
        return self.network.p | screen

    @classmethod
    def of(cls, numbers: dict[str, np.ndarray]) -> Tagger:
        network = Network()
        network.p = {name: numbers[name] for name in network.p}
        return cls(network, Screen(numbers["screen"], float(numbers["bar"])) if "screen" in numbers else Screen.off())

    def runs(self, texts: Sequence[str]) -> list[list[tuple[int, np.ndarray]]]:
        """For each text the stretches (start, tags) that hold a tag other than none."""
        out: list[list[tuple[int, np.ndarray]]] = []
        held, size = [], 0
        for k, text in enumerate(texts):
            held.append(symbols(text))
            size += len(held[-1])
            if size >= SCREEN_CHARS or k == len(texts) - 1:
                out += self._runs(held)
                held, size = [], 0
        return out

    def _runs(self, coded: list[np.ndarray]) -> list[list[tuple[int, np.ndarray]]]:
        step = WINDOW - OVERLAP
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        windows = np.maximum(1, -(-(length - OVERLAP) // step))
        first = np.cumsum(windows) - windows
        begin = first * step + np.arange(len(coded)) * OVERLAP  # of each text; all windows' steps, and an overlap at its end
        flat = np.full(int(windows.sum()) * step + len(coded) * OVERLAP, PAD, np.uint8)
        for at, ids in zip(begin.tolist(), coded, strict=True):
            flat[at : at + len(ids)] = ids
        owner = np.repeat(np.arange(len(coded)), windows)
        starts = begin[owner] + (np.arange(len(owner)) - first[owner]) * step
        marked = np.full(len(owner), np.isneginf(self.screen.bar))
        if not marked.all():
            hits = np.flatnonzero(self.screen.score(flat) >= self.screen.bar)
            text = np.searchsorted(begin, hits, side="right") - 1
            inside = hits - begin[text]
            on = inside < length[text]
            text, inside = text[on], inside[on]
            k = inside // step
            marked[(first[text] + np.minimum(k, windows[text] - 1))] = True
            both = (inside % step < OVERLAP) & (k > 0)
            marked[(first[text] + k - 1)[both]] = True
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in coded]
        chosen = np.flatnonzero(marked)
        if not len(chosen):
            return out
        # stretches of windows that follow each other in a text
        new = np.r_[True, (np.diff(chosen) > 1) | (np.diff(owner[chosen]) > 0)]
        run = np.cumsum(new) - 1
        count = np.bincount(run)
        size = count * step + OVERLAP
        offset = np.cumsum(size) - size
        # all windows begin at multiples of the overlap, so they are moved in units of it
        unit = math.gcd(step, OVERLAP)
        total, weight = np.zeros((int(size.sum()) // unit, unit, TAGS), np.float32), np.zeros((int(size.sum()) // unit, unit, 1), np.float32)
        place = offset[run] + (np.arange(len(chosen)) - np.flatnonzero(new)[run]) * step
        ramp = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32).reshape(-1, unit, 1)
        units, inside = flat.reshape(-1, unit), np.arange(WINDOW // unit)
        for j in range(0, len(chosen), BLOCK):
            ids = units[starts[chosen[j : j + BLOCK], None] // unit + inside].reshape(-1, WINDOW)
            score = self.network.emissions(np.ascontiguousarray(ids.T).astype(np.intp))
            score = score.transpose(1, 0, 2).reshape(-1, *ramp.shape[:2], TAGS) * ramp
            to = place[j : j + BLOCK, None] // unit + inside
            for half in (np.s_[::2], np.s_[1::2]):  # a window overlaps the next one only
                total[to[half]] += score[half]
                weight[to[half]] += ramp
        total /= weight
        total = total.reshape(-1, TAGS)
        tags = self._best(total, offset, size)
        at = starts[chosen[new]]
        for r, path in enumerate(tags):
            t = owner[chosen[new][r]]
            start = int(at[r] - begin[t])
            path = path[: length[t] - start]
            if path.any():
                out[t].append((start, path))
        return out

    def _sure(self, score: np.ndarray) -> np.ndarray:
        """Where the best path has none for sure: no run of other tags over that place, from
        wherever to wherever, gains over none throughout. A run gains at most what its best tags
        do, each by its score and its best move from another, with its first move and its last. A
        margin covers rounding."""
        move = self.network.p["move"].astype(np.float64) - self.network.p["move"][0, 0]
        within = move[1:, 1:].max(axis=0)
        ends = (move[0, 1:] - within).max() + move[1:, 0].max()
        best = score[:, 1] + within[0]
        for tag in range(2, TAGS):
            np.maximum(best, score[:, tag] + within[tag - 1], out=best)
        best -= score[:, 0]
        # the greatest sums of runs that end and that begin at each place
        total = np.concatenate([[0], np.cumsum(best)])
        most = total[1:] - np.minimum.accumulate(total[:-1]) + np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1] - best
        return most + ends < -1e-3 * (1 + abs(ends) + np.abs(most))

    def _best(self, score: np.ndarray, offset: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The best tags of each stretch (its scores from offset on, so many), from none to none.
        The search over a stretch falls into searches between the places where none is sure."""
        open_ = np.zeros(len(score) + 1, np.int8)
        open_[:-1] = ~self._sure(score)
        edge = np.diff(open_, prepend=0)
        edge[offset[open_[offset] > 0]] = 1  # stretches lie side by side
        begins = np.flatnonzero(edge == 1)
        stops = np.flatnonzero(open_[:-1] & ((open_[1:] == 0) | (edge[1:] == 1))) + 1
        tags = np.zeros(len(score), np.int8)
        if len(begins):
            self._search(score, begins, stops - begins, tags)
        return [tags[o : o + z] for o, z in zip(offset.tolist(), size.tolist(), strict=True)]

    def _ahead(self, score: np.ndarray, begin: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of pieces in order of falling size, each searched from its tags before it (piece, way):
        the best sums (way, tag, place) at all places, step by step; of each step the first
        place and the number of pieces that it has; and the places' rows of score."""
        move = self.network.p["move"]
        live = np.searchsorted(-size, -np.arange(int(size[0])))  # pieces longer than each time
        base = np.cumsum(live) - live
        time = np.repeat(np.arange(len(live)), live)
        rows = begin[np.arange(len(time)) - base[time]] + time
        given = np.ascontiguousarray(score[rows].T)
        best = np.empty((entry.shape[1], TAGS, len(rows)), np.float32)
        best[..., : len(size)] = move[entry].transpose(1, 2, 0) + given[:, : len(size)]
        for t in range(1, len(live)):
            b, m = base[t], live[t]
            before = best[..., base[t - 1] : base[t - 1] + m]
            np.add((before[:, :, None] + move[:, :, None]).max(axis=1), given[:, b : b + m], out=best[..., b : b + m])
        return best, base, live, rows

    def _joined(self, sums: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the pieces of stretches that have so many each, from the best sums (piece, tag
        before, last tag): the tag before each piece and its last one, on the best way through."""
        entry, last = np.zeros(len(sums), np.int64), np.zeros(len(sums), np.int64)
        order = np.argsort(-size, kind="stable")
        first, size = (np.cumsum(size) - size)[order], size[order]
        live = np.searchsorted(-size, -np.arange(int(size[0])))
        best, back = sums[first, 0].astype(np.float64), np.zeros((len(sums), TAGS), np.int64)
        for t in range(1, len(live)):
            m = live[t]
            through = best[:m, :, None] + sums[first[:m] + t]
            back[first[:m] + t] = through.argmax(axis=1)
            best[:m] = through.max(axis=1)
        tag = (best + self.network.p["move"][:, 0]).argmax(axis=1)
        for t in range(len(live) - 1, -1, -1):
            at = first[: live[t]] + t
            last[at] = tag[: live[t]]
            tag[: live[t]] = entry[at] = back[at, last[at]]
        return entry, last

    def _search(self, score: np.ndarray, offset: np.ndarray, size: np.ndarray, tags: np.ndarray) -> None:
        """Write the best tags of each stretch, from none to none. Long ones are cut into pieces,
        which are searched from every tag before them, side by side, and then joined, so that a
        long stretch costs no step of its own for every character."""
        move, count = self.network.p["move"], -(-size // PIECE)
        stretch = np.repeat(np.arange(len(size)), count)
        inner = (np.arange(len(stretch)) - (np.cumsum(count) - count)[stretch]) * PIECE
        begin, size = offset[stretch] + inner, np.minimum(PIECE, size[stretch] - inner)
        entry, last = np.zeros(len(begin), np.int64), np.full(len(begin), -1)
        many = np.flatnonzero(count[stretch] > 1)
        order = np.argsort(-size, kind="stable")
        if len(many):
            sums = np.empty((len(begin), TAGS, TAGS), np.float32)
            some = order[count[stretch[order]] > 1]
            for j in range(0, len(some), PIECES):
                part = some[j : j + PIECES]
                best, base, _, _ = self._ahead(score, begin[part], size[part], np.broadcast_to(np.arange(TAGS), (len(part), TAGS)))
                sums[part] = best[..., base[size[part] - 1] + np.arange(len(part))].transpose(2, 0, 1)
            entry[many], last[many] = self._joined(sums[many], count[count > 1])
        for j in range(0, len(order), PIECES):
            part = order[j : j + PIECES]
            best, base, live, rows = self._ahead(score, begin[part], size[part], entry[part, None])
            ends = best[0][:, base[size[part] - 1] + np.arange(len(part))]
            tag = np.where(last[part] < 0, (ends + move[:, :1]).argmax(axis=0), last[part])
            for t in range(len(live) - 1, -1, -1):
                m = live[t]
                tags[rows[base[t] : base[t] + m]] = tag[:m]
                if t:
                    tag[:m] = (best[0][:, base[t - 1] : base[t - 1] + m] + move[:, tag[:m]]).argmax(axis=0)


def plausible(kind: str, text: str) -> bool:
    """What a span of its kind must hold, whatever its form: digits in number and sum, parts."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "email":  # a name, a sign or word for at, a host, and its ending
        parts = re.findall(r"[A-Za-z0-9]+", text)
        return len(parts) >= 3 and parts[-1].isalpha() and ("@" in text or "at" in (p.lower() for p in parts[1:-1]))
    if kind == "secret":
        return len(text) >= 16 and digits != "" and any(c.isalpha() for c in text) and not any(c.isspace() for c in text)
    if any(c.isalpha() for c in text):
        return False
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(map(small_part, parts))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def added_spans(text: str, runs: list[tuple[int, np.ndarray]], base: list[Span]) -> list[Span]:
    """Stretches of one tag, grown over the word that they cut, that overlap no rule's span and
    hold what their kind must."""
    taken = sorted((s, e) for _, s, e in base)
    out: list[Span] = []
    done = {kind: 0 for kind in KINDS}  # where the last span of the kind ends, taken or not
    for offset, tags in runs:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if not tags[a]:
                continue
            kind, start, end = KINDS[tags[a] - 1], offset + a, offset + b
            if start < done[kind]:  # in the word that one before it has grown over
                continue
            while start < end and text[start] in " \t\r\n\"'<>,;:!?=":
                start += 1
            while end > start and text[end - 1] in " \t\r\n\"'<>.,;:!?":
                end -= 1
            while start > done[kind] and not text[start - 1].isspace() and text[start - 1] not in "\"'<>,;:!?=|":
                start -= 1
            while end < len(text) and text[end].isalnum():
                end += 1
            done[kind] = max(end, done[kind])
            k = bisect.bisect_left(taken, (start, start))
            clash = (k < len(taken) and taken[k][0] < end) or (k and taken[k - 1][1] > start)
            if start < end and not clash and plausible(kind, text[start:end]):
                out.append((kind, start, end))
                bisect.insort(taken, (start, end))
    return out


def ordered(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find_spans(tagger: Tagger, texts: Sequence[str]) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the rules, spans that the network adds) of each whole text."""
    out = []
    for text, runs in zip(texts, tagger.runs(texts), strict=True):
        base = base_spans(text)
        out.append((base, added_spans(text, runs, base) if runs else []))
    return out


def sample_value(draw: random.Random, words: list[str]) -> tuple[int, str, str, str]:
    """A tag and a value of its kind, in a form that the rules know or in another, with what stands
    before and after it; or a decoy."""

    def digits(n: int) -> str:
        return "".join(draw.choices("0123456789", k=n))

    def word() -> str:
        return re.sub(r"[^A-Za-z0-9]", "", draw.choice(words)) or "name"

    kind = draw.choice((0, 0, 0, 1, 1, 2, 3, 4, 4, 5, 5))
    if kind == 1:
        at, dot = draw.choice((("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" @ ", "."), (" AT ", " DOT ")))
        return 1, word().lower() + draw.choice(("", "", ".", "_", "-", "")) + draw.choice((word(), digits(2))) + at + word().lower() + draw.choice(("", digits(1))) + dot + draw.choice(("example", "mail", word().lower())) + dot + draw.choice(("com", "org", "net", "de", "io", "fr")), "", ""
    if kind == 2:
        return 2, draw.choice((".", ".", " . ", "-", "[.]")).join(str(draw.randint(0, 255)) for _ in range(4)), "", ""
    if kind == 3:
        body = digits(15)
        body += next(d for d in "0123456789" if luhn(body + d))
        return 3, draw.choice(("", " ", "-", ".", "/")).join(body[k : k + 4] for k in range(0, 16, 4)), "", ""
    if kind == 4:
        a, b, c = digits(3), digits(3), digits(4)
        return 4, draw.choice((f"+{draw.randint(1, 99)} ({a}) {b}-{c}", f"+{draw.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{draw.randint(1, 99)} {a} {b}{c}")), "", ""
    if kind == 5:
        some = "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", k=draw.randint(20, 44)))
        value = draw.choice((draw.randbytes(draw.choice((16, 20, 32))).hex(), draw.randbytes(20).hex(), some, "sk_" + some, "AKIA" + "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))))
        name = draw.choice(("token", "key", "secret", "password", "api_key", word()))
        before, after = draw.choice(((f'{name} = "', '"'), (f"{name}=", ""), (f"{name}: ", ""), ("", ""), ("'", "'")))
        return 5, value, before, after
    return 0, draw.choice((digits(draw.randint(1, 20)), digits(draw.randint(1, 20)), f"{draw.randint(0, 30)}.{draw.randint(0, 9)}", f"{draw.randint(1, 9)}.{draw.randint(0, 20)}.{draw.randint(0, 99)}", f"{draw.randint(1, 28)}-{draw.randint(1, 12)}-{draw.randint(1950, 2030)}", f"${digits(3)}.{digits(2)}", f"{draw.randint(0, 23)}:{digits(2)}", f"@{word()}", f"{word()} at {word()} dot", f"{digits(3)} + {digits(4)}", f"| {word()} | {word()} |", draw.choice("%&#*-=_~") * draw.randint(3, 30), f"{word()}-{word()}_{word()}{word()}", f"http://{word()}/{word()}/{digits(2)}", word() + digits(2))), "", ""


def labelled_spans(text: str) -> list[Span]:
    """The spans that the rules label, and those of a pattern for secrets."""
    return base_spans(text) + [("secret", *m.span()) for m in _SECRET.finditer(text)]


def training_windows(texts: Sequence[str], count: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the sample's words with labelled values put between them, and the sample's own
    windows with their labelled spans."""
    draw = random.Random(seed)
    words = [w for t in texts for w in t.split()] or ["the", "a", "of", "Word", "and."]
    ids, tags = [], []
    labelled = [(t, labelled_spans(t)) for t in texts if len(t) >= TRAIN_WINDOW]
    with_some = [x for x in labelled if x[1]]
    while len(ids) < count:
        if labelled and draw.random() < 0.35:
            text, spans = draw.choice(with_some if with_some and draw.random() < 0.3 else labelled)
            if spans and draw.random() < 0.8:
                _, a, b = draw.choice(spans)
                start = min(max(0, (a + b) // 2 - draw.randint(10, TRAIN_WINDOW - 10)), len(text) - TRAIN_WINDOW)
            else:
                start = draw.randint(0, len(text) - TRAIN_WINDOW)
            tag = np.zeros(TRAIN_WINDOW, np.int64)
            for kind, a, b in spans:
                if b > start and a < start + TRAIN_WINDOW:
                    tag[max(0, a - start) : b - start] = KINDS.index(kind) + 1
            coded = symbols(text[start : start + TRAIN_WINDOW])
        else:
            text, marks = "", []
            value_at = draw.randint(0, 7)
            for k in range(24):
                if k == value_at or draw.random() < 0.04:
                    kind, value, before, after = sample_value(draw, words)
                    text += before
                    marks.append((kind, len(text), len(text) + len(value)))
                    text += value + after + draw.choice((" ", " ", ". ", ", ", "\n", "!! ", " | "))
                else:
                    text += draw.choice(words) + draw.choice((" ", " ", " ", "\n"))
            if len(text) < TRAIN_WINDOW:
                continue
            tag = np.zeros(len(text), np.int64)
            for kind, a, b in marks:
                tag[a:b] = kind
            start = draw.randint(0, max(0, min(40, len(text) - TRAIN_WINDOW)))
            tag, coded = tag[start : start + TRAIN_WINDOW], symbols(text)[start : start + TRAIN_WINDOW]
        if draw.random() < 0.15:  # a text that ends in the window
            upto = draw.randint(1, TRAIN_WINDOW)
            while upto < TRAIN_WINDOW and tag[upto] and tag[upto] == tag[upto - 1]:
                upto += 1
            coded, tag = coded.copy(), tag.copy()
            coded[upto:], tag[upto:] = PAD, 0
        ids.append(coded)
        tags.append(tag)
    return np.stack(ids).astype(np.int64), np.stack(tags)


def train(texts: Sequence[str], steps: int | None = None, windows: int | None = None, screened: bool = False) -> Tagger:
    """A tagger that reads every window; or, if screened, those that a linear screen leaves."""
    network, examples = Network(), training_windows(texts, windows or TRAIN_WINDOWS)
    network.fit(*examples, steps=steps or STEPS)
    if not screened:
        return Tagger(network, Screen.off())
    clean = [np.append(symbols(t), np.uint8(PAD)) for t in texts if not labelled_spans(t)]
    return Tagger(network, Screen.fit(*examples, np.concatenate([*clean, np.zeros(0, np.uint8)])))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """A tagger trained on a bounded sample: the TRAIN_TEXTS rows of least hash, TRAIN_CHARS
    characters of each; an empty sample leaves the generated values among a few fixed words."""
    few = pick(docs, doc_id=id_col, text=text_col).where("text IS NOT NULL")
    chosen = least_by_hash(few, TRAIN_TEXTS, few.count(), "doc_id", "text")
    sample = chosen.select(F.substring("text", 1, TRAIN_CHARS).alias("t"))
    return Tagger.of(fit_in_task(sample, lambda rows: train(sorted(r["t"] for r in rows)).numbers()))


def with_spans(docs: DataFrame, tagger: Tagger, text_col: str = "text", drop: Sequence[str] = ()) -> DataFrame:
    """docs with _base and _all: the rules' spans and all spans of each whole text, written
    kind:start:end in code points, by kind and start. A null or empty text has none; rows are
    independent, so repeated ones repeat theirs; an empty table gives no rows. Other columns pass
    through, but for those named in drop."""
    held = docs.sparkSession.sparkContext.broadcast(tagger.numbers())

    def run(column: pa.Array) -> list[pa.Array]:
        found = find_spans(Tagger.of(held.value), [t or "" for t in column.to_pylist()])
        return [pa.array([ordered(b) for b, _ in found], pa.string()), pa.array([ordered(b + a) for b, a in found], pa.string())]

    return append_columns(docs, [text_col], run, [T.StructField("_base", T.StringType()), T.StructField("_all", T.StringType())], drop)


def mask(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in brackets; of spans that overlap the union is,
    by the kind of the first."""
    out, end = [], 0
    for start, stop, kind in sorted((s, -e, k) for k, s, e in spans):
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, -stop)
    return "".join([*out, text[end:]])


def mask_texts(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """docs with the personal data in the text masked, in one pass; null texts stay null. Rows are
    independent; other columns, whatever their names, pass through; an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(tagger.numbers())

    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        found = find_spans(Tagger.of(held.value), [t or "" for t in texts])
        return pa.array([t if t is None else mask(t, b + a) for t, (b, a) in zip(texts, found, strict=True)], pa.string())

    return replace_column(docs, text_col, run)


def span_report(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of spans of each kind, base_sha256 (of the rules' spans), spans (all) and
    n_added (those that the network adds) of every row. Null and empty texts have none; repeated
    rows are repeated; extra columns are ignored; an empty table gives no rows."""
    found = with_spans(pick(docs, doc_id=id_col, text=text_col), tagger, drop=["text"])

    def count(column: str, what: str) -> Column:
        return F.regexp_count(F.col(column), F.lit(what)).cast("long")

    return found.select(
        "doc_id",
        *[count("_all", f"{k}:").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(F.col("_base").cast("binary"), 256).alias("base_sha256"),
        F.col("_all").alias("spans"),
        count("_all", "secret:").alias("n_secret"),
        count("_all", "[a-z]:").alias("n_spans"),
        (count("_all", "[a-z]:") - count("_base", "[a-z]:")).alias("n_added"),
    )


def op2_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return span_report(docs, fit(docs))
