import hashlib
import random
import re

import numpy as np
import pytest

from orrery.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def by_rules(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": True, "ip": kind == "ip" and max(map(int, m.group().split("."))) <= 255,
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }
            if fits[kind]:
                out.append((kind, *m.span()))
    return out


def test_rules_equal_their_regular_expressions():
    draw = random.Random(2)
    alphabet = ["@", "@", ".", ".", "+", "-", " ", "(", ")", "a", "b", "Z", "_", "%", "é", "\n", *"0123456789", "192.168.0.1", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "me@x.co", "٣"]
    for _ in range(20_000):
        text = "".join(draw.choices(alphabet, k=draw.randint(0, 40)))
        assert pii.base_spans(text) == by_rules(text), text
    pii.base_spans("a" * 300_000 + "@" + "9" * 300_000 + "." * 10)


@pytest.fixture(scope="module")
def tagger():
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefghijklmnoprstuvwéü", k=draw.randint(2, 9))) for _ in range(500)]
    texts = [" ".join(draw.choices(words, k=200)) for _ in range(60)]
    return pii.train(texts, steps=500, windows=5000), words


def test_gradients_are_the_slopes():
    network = pii.Network(seed=1, dtype=np.float64)
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, pii.SYMBOLS, (7, 3)), rng.integers(0, pii.TAGS, (7, 3))
    _, grad = network.step(ids, tags)
    for name, value in network.p.items():
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(4)]:
            kept, losses = value[at], []
            for d in (1e-5, -1e-5):
                value[at] = kept + d
                losses.append(network.step(ids, tags)[0])
            value[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-5 - grad[name][at]) < 1e-4, name


def test_emissions_equal_the_trained_network():
    network = pii.Network(seed=2, dtype=np.float64)
    ids = np.random.default_rng(3).integers(0, pii.SYMBOLS, (9, 4))
    x = network.p["emb"][ids]
    states, _ = network._lstm(np.stack([x, x[::-1]], axis=1))
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
    assert np.allclose(network.emissions(ids), both @ network.p["out"] + network.p["out_b"])


def test_forms_beyond_the_rules_are_found_and_clean_texts_are_not(tagger):
    """Held-out words and values: recall and precision by kind of the spans that the rules miss."""
    model, _ = tagger
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnoprstuvwéü", k=draw.randint(2, 9))) for _ in range(500)]
    hit, given, false = {}, {}, 0
    texts, wanted = [], []
    for _ in range(500):
        kind, value, before, after = pii.sample_value(draw, words)
        lead = " ".join(draw.choices(words, k=draw.randint(0, 90)))
        texts.append(f"{lead} {before}{value}{after} " + " ".join(draw.choices(words, k=40)))
        wanted.append((kind, len(lead) + 1 + len(before), len(lead) + 1 + len(before) + len(value)))
    for (kind, start, end), (base, added) in zip(wanted, pii.find_spans(model, texts), strict=True):
        name = pii.KINDS[kind - 1] if kind else ""
        if kind and not any(s < end and start < e for _, s, e in base):
            given[name] = given.get(name, 0) + 1
            hit[name] = hit.get(name, 0) + ((name, start, end) in added)
        false += any(x != (name, start, end) for x in added)
    assert set(given) == set(pii.KINDS)
    assert sum(hit.values()) >= 0.9 * sum(given.values()), (hit, given)
    assert false <= 0.05 * len(texts), false
    clean = [" ".join(draw.choices(words, k=200)) for _ in range(200)]
    assert sum(bool(a) for _, a in pii.find_spans(model, clean)) <= 2


def test_windows_make_no_difference_to_what_a_text_holds(tagger):
    model, words = tagger
    draw = random.Random(8)
    value = "(555) 123-4567"
    for length in (3, 18, 20, 22, 60, 64, 70, 200, 800):
        before = " ".join(draw.choices(words, k=length))
        text = f"{before} {value} " + " ".join(draw.choices(words, k=300))
        assert ("phone", len(before) + 1, len(before) + 1 + len(value)) in pii.find_spans(model, [text])[0][1], length
    texts = [" ".join(draw.choices(words, k=draw.randint(0, 300))) + " (555) 123-4567" for _ in range(30)]
    together = pii.find_spans(model, texts)
    assert together == [pii.find_spans(model, [t])[0] for t in texts]
    assert all(a for _, a in together)


def test_one_search_over_the_text_finds_the_best_tags(tagger):
    """Against all windows read, averaged and searched in one piece, from none to none."""
    model, words = tagger
    draw = random.Random(4)
    open_ = pii.Tagger(model.network, pii.Screen(model.screen.weights, -1e9))
    for _ in range(12):
        text = " ".join(draw.choices([*words, "1234", "a@b", "(555) 123-4567"], k=draw.randint(1, 90)))
        coded, step = pii.symbols(text), pii.WINDOW - pii.OVERLAP
        n = max(1, -(-(len(coded) - pii.OVERLAP) // step))
        flat = np.full(n * step + pii.OVERLAP, pii.PAD, np.uint8)
        flat[: len(coded)] = coded
        total, weight = np.zeros((len(flat), pii.TAGS)), np.zeros(len(flat))
        for k in range(n):
            score = model.network.emissions(flat[k * step : k * step + pii.WINDOW, None])[:, 0]
            for i in range(pii.WINDOW):
                total[k * step + i] += score[i] * min(i + 1, pii.WINDOW - i)
                weight[k * step + i] += min(i + 1, pii.WINDOW - i)
        total /= weight[:, None]
        move = model.network.p["move"]
        best, back = np.where(np.arange(pii.TAGS) == 0, 0, -np.inf), []
        for row in total:
            through = best[:, None] + move
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + row
        tag = int((best + move[:, 0]).argmax())
        path = []
        for step_back in reversed(back):
            path.append(tag)
            tag = int(step_back[tag])
        want = np.array(path[::-1][: len(coded)])
        (found,) = open_.runs([text])
        got = np.zeros(len(coded), int)
        for start, tags in found:
            got[start : start + len(tags)] = tags
        assert (got == want).all()


def test_the_screen_clears_what_holds_nothing(tagger):
    model, words = tagger
    draw = random.Random(6)
    texts = [" ".join(draw.choices([*words, "(555) 123-4567"], weights=[1] * 500 + [2], k=300)) for _ in range(40)]
    open_ = pii.Tagger(model.network, pii.Screen(model.screen.weights, -1e9))
    screened, full = pii.find_spans(model, texts), pii.find_spans(open_, texts)
    missed = sum(len(set(f[1]) - set(s[1])) for s, f in zip(screened, full, strict=True))
    assert missed <= 0.02 * sum(len(f[1]) for f in full)


def test_every_window_is_read(tagger, monkeypatch):
    model, words = tagger
    draw, read = random.Random(7), []
    seen = model.network.emissions
    monkeypatch.setattr(model.network, "emissions", lambda ids: read.append(ids.shape[1]) or seen(ids))
    texts = ["", "x", *(" ".join(draw.choices(words, k=n)) for n in (5, 300, 3000))]
    found = model.runs(texts)
    step = pii.WINDOW - pii.OVERLAP
    assert len(found) == len(texts) and sum(read) == sum(max(1, -(-(len(t) - pii.OVERLAP) // step)) for t in texts)
    again = pii.Tagger.of(model.numbers())
    assert all(len(a) == len(b) for a, b in zip(again.runs(texts), found, strict=True))


def test_search_between_sure_places_equals_the_whole(tagger, monkeypatch):
    model, _ = tagger
    rng = np.random.default_rng(3)
    size = rng.integers(1, 40, 200)
    offset = np.cumsum(size) - size
    for scale in (0.5, 3.0, 12.0):
        score = rng.normal(0, scale, (int(size.sum()), pii.TAGS)).astype(np.float32)
        score[:, 0] += scale * rng.integers(0, 4, len(score))
        got = model._best(score, offset, size)
        with monkeypatch.context() as whole:
            whole.setattr(pii.Tagger, "_sure", lambda self, score: np.zeros(len(score), bool))
            want = model._best(score, offset, size)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_few_places_are_left_to_the_search(tagger, monkeypatch):
    model, words = tagger
    draw, searched = random.Random(11), []
    plain = model._search
    monkeypatch.setattr(model, "_search", lambda score, offset, size, tags: searched.append(int(size.sum())) or plain(score, offset, size, tags))
    texts = [" ".join(draw.choices([*words, "1999", "3.5", "at"], k=2000)) for _ in range(10)]
    model.runs(texts)
    assert sum(searched) <= 0.01 * sum(map(len, texts))


def test_long_stretches_are_searched_in_pieces(tagger, monkeypatch):
    """Against a search step by step; no search takes more steps than a piece has."""
    model, _ = tagger
    move = model.network.p["move"].astype(np.float64)
    monkeypatch.setattr(pii, "PIECES", 5)
    steps, ahead = [], model._ahead
    monkeypatch.setattr(model, "_ahead", lambda score, begin, size, entry: steps.append(int(size.max())) or ahead(score, begin, size, entry))
    rng = np.random.default_rng(6)
    size = np.array([1, pii.PIECE - 1, 1500, pii.PIECE, pii.PIECE + 1, 2 * pii.PIECE, 2, 700, 1])
    offset = np.cumsum(size) - size
    for scale in (0.5, 3.0):
        score = rng.normal(0, scale, (int(size.sum()), pii.TAGS)).astype(np.float32)
        tags = np.zeros(len(score), np.int8)
        model._search(score, offset, size, tags)
        for o, z in zip(offset, size, strict=True):
            rows, path = score[o : o + z].astype(np.float64), np.concatenate([[0], tags[o : o + z], [0]])
            best = np.where(np.arange(pii.TAGS) == 0, 0, -np.inf)
            for row in rows:
                best = (best[:, None] + move).max(axis=0) + row
            got = rows[np.arange(z), path[1:-1]].sum() + move[path[:-1], path[1:]].sum()
            assert abs(got - (best + move[:, 0]).max()) < 1e-3
    assert max(steps) == pii.PIECE


def test_strange_words_cost_no_quadratic_time():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []
    tags = np.tile(np.array([2, 2, 0, 4, 4, 0], np.int8), 50_000)
    assert pii.added_spans("1" * 300_000, [(0, tags)], []) == []
    assert pii.added_spans("", [], []) == []


def test_documents(spark, tagger):
    model, _ = tagger
    rows = [(1, None), (2, ""), (2, ""), (3, "mail me@x.co now 10.0.0.1."), (None, "é 4111 1111 1111 1111"), (4, "word " * 60_000 + "+1 (555) 010-9999")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _BASE int")
    got = {r.doc_id: r for r in pii.span_report(docs, model).collect()}
    assert len(got) == 5
    for doc_id, text in rows:
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in by_rules(text or ""))
        assert got[doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[doc_id].spans.split(","))
    assert (got[3].n_email, got[3].n_ip, got[None].n_card, got[4].n_phone) == (1, 1, 1, 1)
    masked = {r.doc_id: r.text for r in pii.mask_texts(docs, model).collect()}
    assert masked[3] == "mail [EMAIL] now [IP]." and masked[1] is None and masked[4].endswith("word [PHONE]")
    assert pii.span_report(docs.limit(0), model).count() == 0
    assert pii.mask("abcdef", [("email", 1, 3), ("card", 2, 4)]) == "a[EMAIL]ef"
    secret = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    one = spark.createDataFrame([(1, f'word token = "{secret}" word')], "doc_id long, text string")
    (row,) = pii.span_report(one, model).collect()
    assert row.spans == "secret:14:54" and (row.n_secret, row.n_spans, row.n_added, row.n_card) == (1, 1, 1, 0)
