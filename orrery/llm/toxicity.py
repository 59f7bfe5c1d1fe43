"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained in numpy."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, arrow_map, as_bytes, fit_in_task, least_by_hash, pick, table

#: The bound of the training sample: labelled texts of each class (clean, toxic), and bytes of a
#: text in it; EDITED of each class are used a second time with misspelt words.
TRAIN_TEXTS = (2000, 1200)
TRAIN_BYTES = 5_000
EDITED = 1200
GRAMS = (3, 4, 5)
BUCKET_BITS = 17
DIMENSIONS = 8
#: A text is scored as a whole and by windows of so many words, half overlapping; the highest counts.
WINDOW = 4
EPOCHS, WARM_EPOCHS = 70, 12
#: What the second label weighs in training beside toxicity.
SIDE_WEIGHT = 0.3
#: Spreads a word's weight over its n-grams, so that a misspelling keeps much of it.
DECAY = 1e-5
THRESHOLD = 0.7
#: Different words taken at a time in training.
WORDS_AT_ONCE = 20_000
#: Bytes featurised at a time, whole words only.
CHUNK_BYTES = 1 << 15

_MIX = np.random.default_rng(20240607).integers(1, 1 << 32, GRAMS[-1] + 2, dtype=np.uint32) | np.uint32(1)
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> bytes:
    """The words of a text in lower case, with a mark (zero byte) around each; none: one mark."""
    words = text.decode("utf-8", "replace").lower().encode().translate(_LETTERS).split()
    return b"\0".join([b"", *words, b""]) if words else b"\0"


def gram_buckets(raw: np.ndarray):
    """For each n-gram length: the bucket of the n-gram from each position on, and where there is
    one, that is where no mark lies inside it."""
    values = raw.astype(np.uint32)
    values += np.uint32(1)
    marks = np.concatenate([[0], np.cumsum(raw == 0, dtype=np.int32)])
    hashed = np.zeros(len(raw), np.uint32)
    for n in range(1, GRAMS[-1] + 1):
        m = len(raw) - n + 1
        if m < 1:
            return
        hashed = hashed[:m]
        hashed += values[n - 1 :] * _MIX[n]
        if n in GRAMS:
            bucket = hashed + np.uint32(int(_MIX[0]) * n % (1 << 32))
            bucket ^= bucket >> np.uint32(15)
            bucket *= _MIX[-1]
            bucket >>= np.uint32(32 - BUCKET_BITS)
            yield bucket, marks[n - 1 : n - 1 + m] == marks[1 : 1 + m]


def features(words: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, word number) of every character n-gram of the words, with their ends marked, by
    word; the number of words."""
    raw = np.frombuffer(words, dtype=np.uint8)
    number = np.cumsum(raw == 0) - 1  # of the word after the last mark up to here
    made = [(bucket[at].astype(np.int32), number[: len(at)][at].astype(np.int32)) for bucket, at in gram_buckets(raw)]
    buckets, owners = (np.concatenate(x) for x in zip(*made, strict=True))
    order = np.argsort(owners, kind="stable")
    return buckets[order], owners[order], int(number[-1])


def misspelt(word: str, draw: random.Random) -> str:
    """word with one random edit, for training: all classes alike get such words."""
    if len(word) < 4:
        return word
    i, kind = draw.randrange(1, len(word) - 1), draw.randrange(5)
    if kind == 0:
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :]
    if kind == 1:
        return word[:i] + word[i] * draw.randint(2, 3) + word[i + 1 :]
    if kind == 2:
        return word[:i] + word[i + 1 :]
    if kind == 3:
        return word[:i] + draw.choice("0123456789") + word[i + 1 :]
    return word[:i] + draw.choice("abcdefghijklmnopqrstuvwxyz") + word[i + 1 :]


class Model:
    """The trained embeddings times the softmax's weights, by bucket, and its bias; the embeddings
    and weights themselves where it has just been trained."""

    def __init__(self, by_bucket: np.ndarray, bias: float, embeddings: np.ndarray | None = None, weights: np.ndarray | None = None) -> None:
        self.by_bucket, self.bias, self.embeddings, self.weights = by_bucket, bias, embeddings, weights

    def word_logits(self, words: bytes) -> np.ndarray:
        found, start = [], 0
        while start < len(words) - 1:
            end = len(words) if len(words) - start <= CHUNK_BYTES else words.rfind(b"\0", start + 1, start + CHUNK_BYTES) + 1
            if end <= start + 1:  # a word of more than a chunk
                end = words.index(b"\0", start + 1) + 1
            raw = np.frombuffer(words[start:end], dtype=np.uint8)
            total, grams = np.zeros(len(raw), np.float32), np.zeros(len(raw), np.int32)
            for bucket, at in gram_buckets(raw):
                total[: len(at)] += np.where(at, self.by_bucket.take(bucket, mode="wrap"), np.float32(0))
                grams[: len(at)] += at
            marks = np.flatnonzero(raw == 0)[:-1]
            if len(marks):
                found.append(np.add.reduceat(total, marks) / np.maximum(1, np.add.reduceat(grams, marks)))
            start = end - 1
        return np.concatenate(found) if found else np.zeros(0, np.float32)

    def _from_logits(self, logits: np.ndarray) -> float:
        best = self.bias + (float(window_means(logits).max()) if len(logits) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(best, -40, 40))))

    def score(self, text: bytes) -> float:
        return self._from_logits(self.word_logits(words_of(text)))

    def scores(self, texts: list[bytes]) -> list[float]:
        """As score(), with the words of many short texts featurised together."""
        out, held, size = [], [], 0
        for k, text in enumerate(texts):
            held.append(words_of(text))
            size += len(held[-1])
            if size >= CHUNK_BYTES or k == len(texts) - 1:
                logits = self.word_logits(b"".join([b"\0", *[w[1:] for w in held]]))
                at = 0
                for w in held:
                    n = w.count(b"\0") - 1
                    out.append(self._from_logits(logits[at : at + n]))
                    at += n
                held, size = [], 0
        return out


def window_bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole of n words, then ranges of WINDOW words, each half over the last; the final one
    ends where the words end."""
    if n <= WINDOW:
        return np.zeros(1, np.int64), np.full(1, n)
    starts = np.minimum(np.arange(0, n - WINDOW + WINDOW // 2, WINDOW // 2), n - WINDOW)
    return np.append(0, starts), np.append(n, starts + WINDOW)


def window_means(logits: np.ndarray) -> np.ndarray:
    starts, ends = window_bounds(len(logits))
    total = np.concatenate([[0.0], np.cumsum(logits, dtype=np.float64)])
    return (total[ends] - total[starts]) / (ends - starts)


class Bags:
    """Texts as bags of bags: words over a table of the n-grams met, windows over the words."""

    def __init__(self, index: dict[bytes, int], ids: list[np.ndarray]) -> None:
        """index: a number for each different word; ids: each text's words."""
        words, buckets, sizes = list(index), [], []
        for k in range(0, len(words), WORDS_AT_ONCE):  # a part at a time, as sorting all takes much memory
            bucket, owner, count = features(b"\0" + b"\0".join(words[k : k + WORDS_AT_ONCE]) + b"\0")
            buckets.append(bucket)
            sizes.append(np.bincount(owner, minlength=count))
        bucket, self.size = np.concatenate(buckets), np.concatenate(sizes)
        self.first = np.cumsum(self.size) - self.size
        self.used = np.flatnonzero(np.bincount(bucket, minlength=1 << BUCKET_BITS))
        number = np.zeros(1 << BUCKET_BITS, np.int32)
        number[self.used] = np.arange(len(self.used), dtype=np.int32)
        self.gram = number[bucket]
        self.flat = np.concatenate(ids)
        bounds = [window_bounds(len(own)) for own in ids]
        base = np.cumsum([0, *map(len, ids)])
        self.starts = np.concatenate([s + b for (s, _), b in zip(bounds, base, strict=False)]).astype(np.int32)
        self.ends = np.concatenate([e + b for (_, e), b in zip(bounds, base, strict=False)]).astype(np.int32)
        windows = np.array([len(s) for s, _ in bounds])
        self.text_of, self.whole = np.repeat(np.arange(len(ids), dtype=np.int32), windows), np.cumsum(windows) - windows

    def _parts(self):
        """Ranges of words, and of the grams that they hold."""
        ends = self.first + self.size
        for k in range(0, len(self.size), WORDS_AT_ONCE):
            last = min(k + WORDS_AT_ONCE, len(self.size))
            yield slice(k, last), slice(int(self.first[k]), int(ends[last - 1]))

    def means(self, by_gram: np.ndarray) -> np.ndarray:
        """The mean over each window's words of the mean over each word's n-grams."""
        by_word = np.empty(len(self.size))
        for words, grams in self._parts():
            by_word[words] = np.add.reduceat(by_gram[self.gram[grams]], self.first[words] - grams.start) / self.size[words]
        running = np.concatenate([[0.0], np.cumsum(by_word[self.flat])])
        return (running[self.ends] - running[self.starts]) / (self.ends - self.starts)

    def back(self, windows: np.ndarray, error: np.ndarray) -> np.ndarray:
        """The n-grams' shares of errors in the means of these windows."""
        step = np.zeros(len(self.flat) + 1)  # each window's error in equal parts to its words
        part = error / (self.ends[windows] - self.starts[windows])
        np.add.at(step, self.starts[windows], part)
        np.subtract.at(step, self.ends[windows], part)
        by_word = np.bincount(self.flat, weights=np.cumsum(step)[:-1], minlength=len(self.size)) / self.size
        out = np.zeros(len(self.used))
        for words, grams in self._parts():
            out += np.bincount(self.gram[grams], weights=np.repeat(by_word[words], self.size[words]), minlength=len(self.used))
        return out


def highest(z: np.ndarray, text_of: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first highest window of each text."""
    at = np.flatnonzero(z == np.maximum.reduceat(z, first)[text_of])
    return at[np.unique(text_of[at], return_index=True)[1]]


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights by which both labels count the same; they sum to 1."""
    share = np.clip(y.mean(), 1e-9, 1 - 1e-9)
    return np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)


def train(texts: list[str], toxic: list[int], side: list[int] | None = None, seed: int = 11) -> Model:
    """Embeddings and softmax weights together, by Adam: on all windows of a text first, each with
    the label of its text, then on its highest window, which is what the score is taken from. A
    second label (side: 0, 1, or -1 for unknown), predicted from the average of the whole text,
    shares the embeddings. They begin at random; n-grams that were never seen weigh nothing."""
    draw = random.Random(seed)
    rows, times, ids = [], {}, []
    index: dict[bytes, int] = {}

    def add(k: int, words: list[bytes]) -> None:
        rows.append(k)
        ids.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))

    for k, (text, label) in enumerate(zip(texts, toxic, strict=True)):
        own = [w for w in words_of(text.encode()).split(b"\0") if w]
        if not own:
            continue
        add(k, own)
        times[label] = times.get(label, 0) + 1
        if times[label] <= EDITED:
            edited = [misspelt(w.decode("utf-8", "replace"), draw).encode() for w in own]
            add(k, [w for w in words_of(b" ".join(edited)).split(b"\0") if w])
    y = np.array(toxic, dtype=np.float64)[rows]
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(1 << BUCKET_BITS), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -20, 20)))
    other = np.array(side if side is not None else [-1] * len(texts), dtype=np.float64)[rows]
    known = np.flatnonzero(other >= 0)
    held = Bags(index, ids)
    weigh, weigh_side = balanced(y), SIDE_WEIGHT * balanced(other[known]) if len(known) else np.zeros(0)

    # Of two classes' softmax only the difference of their weights counts: a column for each label.
    # It is linear, so the mean of embeddings times the weights is the mean of these.
    rng = np.random.default_rng(seed)
    value = [rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (len(held.used), DIMENSIONS)), rng.normal(0, 1, (DIMENSIONS, 2)), np.array([-1.0, 0.0])]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in value]
    for epoch in range(1, EPOCHS + 1):
        emb, weight, bias = value
        by_gram = emb @ weight
        z = held.means(by_gram[:, 0]) + bias[0]
        if epoch <= WARM_EPOCHS:
            at = np.arange(len(z))
            share = weigh[held.text_of] / np.bincount(held.text_of)[held.text_of]
        else:
            at, share = highest(z, held.text_of, held.whole), weigh
        error = (1 / (1 + np.exp(-z[at])) - y[held.text_of[at]]) * share
        whole = held.whole[known]
        z_side = held.means(by_gram[:, 1])[whole] + bias[1]
        error_side = (1 / (1 + np.exp(-z_side)) - other[known]) * weigh_side
        back = np.stack([held.back(at, error), held.back(whole, error_side)], axis=1)
        grads = (back @ weight.T + DECAY * emb, emb.T @ back + 1e-5 * weight, np.array([error.sum(), error_side.sum()]))
        rate = 0.05 if epoch > WARM_EPOCHS else 0.1
        for k, grad in enumerate(grads):
            m, v = moments[k]
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            value[k] = value[k] - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
            moments[k] = m, v
    by_bucket = np.zeros(1 << BUCKET_BITS)
    by_bucket[held.used] = value[0] @ value[1][:, 0]
    return Model(by_bucket, float(value[2][0]), value[0], value[1])


def held_out(doc_id) -> F.Column:
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3) == 1


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    side_col: str = "quality",
) -> Model:
    """A model of the labels of rows that aren't held out. The sample is bounded: per class the
    TRAIN_TEXTS ids of least hash, texts of at most TRAIN_BYTES. Null ids and texts and labels
    other than 0 and 1 are left out; an id with both labels counts as toxic. side_col, where the
    labels have it, is the second label, used in training only."""
    names = {"doc_id": id_col, "toxic": label_col} | ({"side": side_col} if side_col in labels.columns else {})
    known = pick(labels, **names).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    side = F.when(F.col("side").isin(0, 1), F.col("side").cast("int")) if "side" in names else F.lit(None).cast("int")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.coalesce(F.max(side), F.lit(-1)).alias("side"))
    texts = pick(docs, doc_id=id_col, text=text_col).where(F.octet_length("text") <= TRAIN_BYTES)
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [least_by_hash(known.where(F.col("toxic") == k), TRAIN_TEXTS[k], counts.get(k, 0), "doc_id") for k in (0, 1)]
    # at most sum(TRAIN_TEXTS) ids, and one text of each: the least, where an id has several
    held = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    sample = held.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("side").alias("side"), F.min("text").alias("text"))

    def learn(rows: list[dict]) -> dict[str, np.ndarray]:
        rows.sort(key=lambda r: r["doc_id"])
        model = train(*([r[name] for r in rows] for name in ("text", "toxic", "side")))
        return {"by_bucket": model.by_bucket, "bias": np.array(model.bias)}

    found = fit_in_task(sample, learn)
    return Model(found["by_bucket"], float(found["bias"]))


def _scorer(docs: DataFrame, model: Model):
    """A function from an array of texts to their scores, whose model travels as a broadcast of
    fixed size."""
    held = docs.sparkSession.sparkContext.broadcast((model.by_bucket.astype(np.float32), model.bias))
    return lambda texts: Model(*held.value).scores(as_bytes(texts))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score", drop: Sequence[str] = ()) -> DataFrame:
    """docs with the score of every whole text; null and empty texts get the bias alone. Rows are
    independent: repeated ones repeat their scores, an empty table gives no rows. Other columns
    pass through, but for those named in drop and one that already has the new name."""
    scores = _scorer(docs, model)
    return append_columns(docs, [text_col], lambda texts: [pa.array(scores(texts), pa.float64())], [T.StructField(name, T.DoubleType())], drop)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of docs whose score is below threshold, with their columns, whatever their names.
    Null and empty texts stay unless the bias alone reaches it; of repeated rows all stay or none."""
    scores = _scorer(docs, fit(docs, labels, text_col=text_col, **columns))
    names, at = docs.columns, docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in scores(batch.column(at))], pa.bool_()))

    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return arrow_map(flat, keep, flat.schema).toDF(*names)


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id are scored; they are not held out, and, as no label is theirs, teach nothing."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_score(pick(docs, doc_id="doc_id", text="text"), model, drop=["text"])
    return scored.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
