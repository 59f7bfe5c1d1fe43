import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from orrery.llm import bpe

PATH, PATTERN = bpe.vocabulary()
RANKS = bpe.read_ranks(PATH)
MERGES = bpe.compile_merges(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.Tokenizer(RANKS, MERGES, PATTERN)
MACHINE = bpe.Utf8Machine({rank: token for token, rank in RANKS.items()})
POOL = [*"aaaabcdeeéèß 0123 \n\t\r.,!?-_'\"{}<>~`", "日", "本", "🙂", "‍", "ñ", "Ж", "и", "\x1c", "\x85", "　", "²", "ª", "Ⅷ", "'s", "'ll", "the", "ing", "   ", "<|endoftext|>"]
ODD = ["", " ", "  ", "a" * 5000, "ab" * 3000, " " * 4000, "\n" * 999 + "x", "the" * 3000, " a b", "a b ", "a  b c", "a\n b", "a \nb c", "a \n", "it's 's b", "x \x1c y", "a　 b", "　 b", "b \x85"]


def texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(POOL, k=draw.randint(0, 60))) for _ in range(n)]


def one_by_one(machine, pieces):
    tokens, counts = machine.encode(pieces)
    return [part.tolist() for part in np.split(tokens, np.cumsum(counts)[:-1])]


def test_tokens_equal_the_library():
    for text in [*texts(1500, 1), *ODD]:
        assert OWN.encode(text) == LIBRARY.encode_ordinary(text)


def test_texts_together_equal_texts_alone(monkeypatch):
    some = [*texts(2000, 6), *ODD, *texts(20, 1)]
    for chunk in (1 << 20, 200):
        monkeypatch.setattr(bpe, "CHUNK_BYTES", chunk)
        tokens, counts = bpe.Tokenizer(RANKS, MERGES, PATTERN).encode_all(pa.array(some, pa.large_string()))
        found = [part.tolist() for part in np.split(tokens, np.cumsum(counts)[:-1])]
        assert found == [LIBRARY.encode_ordinary(t) for t in some]


def test_small_tables_change_nothing(monkeypatch):
    for name, size in (("MOST_STATES", 50), ("MOST_MOVES", 80), ("MOST_WAYS", 20), ("MOST_UNITS", 3), ("MOST_CHARS", 9), ("LANES", 4), ("CHUNK_BYTES", 99)):
        monkeypatch.setattr(bpe, name, size)
    small = bpe.Tokenizer(RANKS, MERGES, PATTERN)
    for text in [*texts(200, 2), "abracadabra" * 2000]:
        assert small.encode(text) == LIBRARY.encode_ordinary(text)


def test_any_vocabulary_of_merges():
    draw = random.Random(4)
    for _ in range(40):  # every rank is a merge of two earlier tokens
        ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
        while len(ranks) < 25:
            new = draw.choice(list(ranks)) + draw.choice(list(ranks))
            ranks.setdefault(new, len(ranks))
        machine = bpe.Transducer(bpe.compile_merges(ranks))
        pieces = [bytes(draw.choices(b"abc", k=draw.randint(1, 40))) for _ in range(60)]
        want = [bpe.merge_by_rank(piece, ranks) for piece in pieces]
        assert one_by_one(machine, pieces) == want
        assert [list(machine.stream([p[:7], p[7:]])) for p in pieces] == want


def test_a_byte_beyond_the_vocabulary_is_refused():
    machine = bpe.Transducer(bpe.compile_merges({b"a": 0, b"b": 1, b"ab": 2}))
    assert one_by_one(machine, [b"abab"]) == [[2, 2]]
    with pytest.raises(ValueError):
        machine.encode([b"ac"])


def test_long_pieces_go_through_in_parts(monkeypatch):
    draw = random.Random(8)
    monkeypatch.setattr(bpe, "CHECK_BYTES", 8)
    monkeypatch.setattr(bpe, "LONG_PIECE", 10)
    for _ in range(50):
        machine = bpe.Transducer(MERGES)
        piece = bytes(draw.choices(b"etaoin", k=draw.randint(8, 60)))
        with monkeypatch.context() as small:  # states are made anew inside the piece
            small.setattr(bpe, "MOST_STATES", 2)
            assert one_by_one(machine, [piece]) == [bpe.merge_by_rank(piece, RANKS)]
        for end in (9, 8, 10, 12, len(piece)):
            assert one_by_one(machine, [piece[:end]]) == [bpe.merge_by_rank(piece[:end], RANKS)]


def test_tokens_come_before_the_piece_ends():
    machine = bpe.Transducer(MERGES)
    ahead = []

    def parts():
        for k in range(200):
            ahead.append(k)
            yield b"information retrieval"

    tokens = machine.stream(parts())
    first = next(tokens)
    assert len(ahead) <= 4
    assert [first, *tokens] == bpe.merge_by_rank(b"information retrieval" * 200, RANKS)


def test_equal_keys_are_told_apart(monkeypatch):
    machine = bpe.Transducer(MERGES)
    monkeypatch.setattr(np, "add", type("Add", (), {"reduceat": staticmethod(lambda x, at: np.zeros(len(at), np.uint64)), "at": np.add.at}))
    sizes, last, node = np.array([1, 2, 1, 1]), np.array([5, 5, 6, 7, 5]), np.array([0, 1, 0, 0, 0])
    found = machine._states_of(sizes, last, node).tolist()
    assert found[0] == found[3] and len(set(found)) == 3


def test_streams_decode_whatever_the_chunks():
    draw = random.Random(3)
    for text in texts(400, 5):
        tokens = np.array(OWN.encode(text), dtype="<u4")
        assert "".join(bpe.decode(MACHINE, tokens, draw.randint(1, 4))) == text
    byte = {b: RANKS[bytes([b])] for b in range(256)}
    for raw in (b"a\xe6b", b"\xff", b"\xe6\x97", b"\xf0\x9f\x99\x82\x80z", b"ok\xc3"):
        tokens = np.array([byte[b] for b in raw], dtype="<u4")
        assert "".join(bpe.decode(MACHINE, tokens, 100)) == raw.decode("utf-8", "replace")


def test_documents(spark):
    rows = [(1, "Hello wörld", 7), (1, "Hello wörld", 7), (2, None, 7), (3, "", 7), (None, "日本" * 30_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TOKENS int")
    got = bpe.token_digests(docs, PATH, PATTERN).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        raw = np.array(ids, dtype="<u4").tobytes()
        want.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.token_digests(docs.limit(0), PATH, PATTERN).count() == 0


def test_two_passes_equal_one(spark):
    rows = [(1, "Hello wörld", 7), (2, None, 7), (3, "", 8), (3, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TOKENS int")
    coded = bpe.encode_texts(docs, PATH, PATTERN)
    assert coded.columns == ["doc_id", "text", "TOKENS", "tokens"]
    apart = bpe.decode_tokens(coded.toDF("doc_id", "text", "other", "tokens"), PATH).collect()
    together = bpe.code_texts(docs, PATH, PATTERN).toDF("doc_id", "text", "other", "tokens", "decoded").collect()
    assert sorted(map(str, apart)) == sorted(map(str, together))
    old = docs.toDF("doc_id", "decoded", "tokens")
    assert bpe.code_texts(old, PATH, PATTERN, "decoded").columns == ["doc_id", "tokens", "decoded"]
    assert [r.decoded for r in sorted(apart)] == ["Hello wörld", "", "", ""]
