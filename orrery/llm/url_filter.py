"""URL filter: rules by host and path, and a weighted vocabulary that an Aho-Corasick automaton counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, pick, table
from .words import flat_bytes

#: A url is rejected once its different hits weigh so much: one strict term or several soft ones.
LIMIT = 2
STRICT = ("casino", "escorts", "jackpot", "malware", "poker", "porn", "porno", "spam", "torrent", "viagra", "warez", "xxx")
SOFT = ("ad", "ads", "adult", "bet", "bets", "bonus", "cheap", "click", "dating", "free", "game", "games", "loan", "loans", "lottery", "nude", "pills", "popup", "promo", "sex", "slots", "track", "tracker", "tracking", "win", "x")
VOCABULARY = {**dict.fromkeys(STRICT, LIMIT), **dict.fromkeys(SOFT, 1)}
#: (verdict, host and path); the longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Bytes that an automaton's lane steps through; the lanes of a batch step together.
LANE = 256
HITS = (T.StructField("n_strict", T.LongType()), T.StructField("n_soft", T.LongType()), T.StructField("weight", T.LongType()))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Automaton:
    """step[state, byte] is the next state; ends[state] the numbers of the terms that end there."""

    step: np.ndarray
    ends: tuple[tuple[int, ...], ...]
    lengths: np.ndarray


def automaton(terms: Sequence[bytes]) -> Automaton:
    """The terms' trie, its failure links followed into a table of all moves. Its size is that of
    the vocabulary: 256 moves for each byte of the terms."""
    children: list[dict[int, int]] = [{}]
    ends: list[list[int]] = [[]]
    for number, term in enumerate(terms):
        state = 0
        for byte in term:
            if byte not in children[state]:
                children[state][byte] = len(children)
                children.append({})
                ends.append([])
            state = children[state][byte]
        ends[state].append(number)
    step = np.zeros((len(children), 256), np.int32)
    fail = [0] * len(children)
    waiting = deque([0])
    while waiting:
        state = waiting.popleft()
        step[state] = step[fail[state]] if state else 0
        for byte, child in children[state].items():
            fail[child] = int(step[fail[state], byte]) if state else 0
            step[state, byte] = child
            ends[child] += ends[fail[child]]
            waiting.append(child)
    return Automaton(step, tuple(map(tuple, ends)), np.array([len(t) for t in terms], np.int64))


def occurrences(machine: Automaton, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, term) of every occurrence in data (end exclusive), overlapping ones too. Data is cut into
    lanes that all step at once; each begins early enough to see any term that ends in it."""
    if not len(data) or not len(machine.lengths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    early = int(machine.lengths.max()) - 1
    lanes = -(-len(data) // LANE)
    held = np.zeros(early + lanes * LANE, np.uint8)
    held[early : early + len(data)] = data
    starts = np.arange(lanes) * LANE
    state = np.zeros(lanes, np.int32)
    final = np.array([bool(e) for e in machine.ends])
    at, reached = [], []
    for k in range(early + LANE):
        state = machine.step[state, held[starts + k]]
        if k >= early:
            hit = np.flatnonzero(final[state])
            at.append(starts[hit] + (k - early + 1))
            reached.append(state[hit])
    at, reached = np.concatenate(at), np.concatenate(reached)
    known = at <= len(data)
    at, reached = at[known], reached[known]
    n = np.array([len(e) for e in machine.ends])
    flat = np.array([t for e in machine.ends for t in e], np.int64)
    first = np.cumsum(n) - n
    times = n[reached]
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(at, times), flat[np.repeat(first[reached], times) + place]


#: Letters and digits, and all bytes of characters beyond ASCII: no term begins or ends beside one.
_JOINS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def weigh(urls: pa.Array, vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT) -> list[pa.Array]:
    """For each url: occurrences of strict terms (those that weigh the limit or more), different soft
    terms, and the weight of all different terms. A-Z count as lower case; null holds none."""
    terms = sorted(vocabulary)
    weights = np.array([vocabulary[t] for t in terms], np.int64)
    machine = automaton([t.encode() for t in terms])
    data, starts = flat_bytes(urls)
    rows = len(starts) - 1
    # a byte that is in no term, and joins none, after each url
    parted = np.full(len(data) + rows + 1, 10, np.uint8)
    row_of = np.repeat(np.arange(rows), np.diff(starts))
    parted[1 + np.arange(len(data)) + row_of] = np.frombuffer(data.tobytes().lower(), np.uint8)
    end, term = occurrences(machine, parted)
    begin = end - machine.lengths[term]
    open_ = ~_JOINS[parted[begin - 1]] & ~_JOINS[parted[np.minimum(end, len(parted) - 1)]]
    end, term = end[open_], term[open_]
    row = np.searchsorted(starts[:-1] + np.arange(rows) + 1, end - 1, "right") - 1
    strict = weights[term] >= limit
    pair = np.unique(row * len(terms) + term) if len(row) else np.zeros(0, np.int64)
    row_, term_ = np.divmod(pair, max(1, len(terms)))
    soft = weights[term_] < limit
    return [
        pa.array(np.bincount(row[strict], minlength=rows).astype(np.int64)),
        pa.array(np.bincount(row_[soft], minlength=rows).astype(np.int64)),
        pa.array(np.bincount(row_, weights[term_], rows).astype(np.int64)),
    ]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies between the first :// and the next /, ? or # (A-Z in lower case), and from there to the
    next ? or #; both empty where there is no ://, or no url."""
    host, path = (F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The struct (size, verdict, rule) of the longest of the rules that fit; null if none does. A rule fits
    its host and all subdomains, where the path starts with its path. Of a rule that is listed twice
    with different verdicts, block wins."""
    if not rules:
        return F.lit(None).cast("struct<size int, verdict string, rule string>")
    fits = []
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        one = (F.concat(F.lit("."), host).endswith(f".{name}")) & path.startswith(f"/{rest}")
        found = F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        fits.append(F.when(one, found))
    # array_max passes nulls over, so what fits is left; by size, then block after allow
    return F.array_max(F.array(*fits))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    vocabulary: Mapping[str, int] = VOCABULARY,
    limit: int = LIMIT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft and weight of every row.

    The longest rule that fits decides; where none does, a url is blocked if its different terms
    weigh the limit or more, terms counting only where no letter or digit stands beside them. Rules
    and vocabulary are parameters of the job, known to the driver, and so bounded by it. A null url
    has empty host and path, fits no rule and is allowed; urls of any length are read whole; repeated
    rows are judged alike; an empty table gives no rows; other columns are ignored."""
    base = pick(pages, page_id=id_col, url=url_col)
    made = append_columns(base, ["url"], lambda urls: weigh(urls, vocabulary, limit), HITS)
    host, path = host_and_path(F.col("url"))
    made = made.select("page_id", host.alias("host"), path.alias("path"), *[f.name for f in HITS])
    made = made.withColumn("best", longest_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("weight") >= limit, "block").otherwise("allow")
    return made.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", own).alias("verdict"), "n_strict", "n_soft", "weight"
    )


def op12_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
