import random
import zlib

import numpy as np

from orrery.llm import toxicity

BAD = ["grumbolt", "vexilode", "snarfick"]


def texts(n, seed, vocabulary, bad=()):
    draw, out = random.Random(seed), []
    for _ in range(n):
        words = draw.choices(vocabulary, k=draw.randint(30, 150))
        for w in bad and draw.choices(bad, k=max(1, len(words) // 30)):
            words.insert(draw.randrange(len(words)), w)
        out.append(" ".join(words) + ".")
    return out


def vocabulary():
    draw = random.Random(0)
    syllables = ["ta", "ren", "mi", "kol", "us", "ber", "in", "dra", "so", "él"]
    return ["".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(300)]


def test_held_out_texts_and_unseen_misspellings():
    words = vocabulary()
    model = toxicity.train(texts(150, 1, words, BAD) + texts(200, 2, words), [1] * 150 + [0] * 200)
    hit = [model.score(t.encode()) >= 0.7 for t in texts(100, 3, words, BAD)]
    false = [model.score(t.encode()) >= 0.7 for t in texts(300, 4, words)]
    assert sum(hit) >= 97 and sum(false) <= 6
    draw = random.Random(9)
    spelt = [toxicity.misspelt(draw.choice(BAD), draw) for _ in range(100)]
    hit = [model.score(f"{' '.join(words[:40])} {w} {' '.join(words[40:60])}".encode()) >= 0.7 for w in spelt]
    assert sum(hit) >= 70
    again = toxicity.train(texts(150, 1, words, BAD) + texts(200, 2, words), [1] * 150 + [0] * 200)
    assert (again.by_bucket == model.by_bucket).all() and again.bias == model.bias
    # a word far into a very long text counts as one in a short one
    long = " ".join(random.Random(5).choices(words, k=200_000))
    assert model.score(f"{long} {BAD[0]} {words[0]}".encode()) >= 0.7
    many = [t.encode() for t in [*texts(40, 6, words, BAD), "", " .", "x"]]
    assert max(abs(a - model.score(t)) for a, t in zip(model.scores(many), many, strict=True)) < 1e-6


def test_one_class_or_no_labels_give_a_constant(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (None, "a b", 0)], "doc_id long, text string, SCORE int")
    labels = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.with_score(docs, model).collect()
    assert len(got) == 4 and all(0 <= r[-1] < 0.01 for r in got)
    assert toxicity.drop_toxic(docs, labels).count() == 4
    assert toxicity.with_score(docs.limit(0), model).count() == 0


def test_held_out_ids_teach_nothing(spark):
    words = vocabulary()
    bad, good = texts(80, 7, words, BAD), texts(80, 8, words)
    rows = [(i, t, int(i < 80)) for i, t in enumerate(bad + good)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    mine = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    all_labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    flipped = spark.createDataFrame([(r[0], r[2] if r in mine else 1 - r[2]) for r in rows], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, all_labels), toxicity.fit(docs, flipped)
    assert (a.by_bucket == b.by_bucket).all()
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, all_labels).collect()}
    assert len(kept & set(range(80))) <= 8 and len(kept & set(range(80, 160))) >= 72


def plain_score(model, text):
    """The score by its definition, n-gram by n-gram."""
    mix = [int(x) for x in toxicity._MIX]
    words = [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split(" ") if w]
    by_word = []
    for word in words:
        marked, weights = b"\0" + word.encode() + b"\0", []
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                h = sum((marked[i + k] + 1) * mix[k + 1] for k in range(n)) + mix[0] * n & 0xFFFFFFFF
                h = (h ^ h >> 15) * mix[-1] & 0xFFFFFFFF
                weights.append(model.by_bucket[h >> 32 - toxicity.BUCKET_BITS])
        by_word.append(sum(weights) / max(1, len(weights)))
    n, size = len(by_word), toxicity.WINDOW
    spans = [(0, n)] + [(min(s, n - size), min(s, n - size) + size) for s in range(0, n, size // 2) if n > size]
    best = max(sum(by_word[a:b]) / max(1, b - a) for a, b in spans) if n else 0.0
    return 1 / (1 + np.exp(-(model.bias + best)))


def test_scores_equal_their_definition():
    words = vocabulary()
    model = toxicity.train(texts(60, 1, words, BAD) + texts(60, 2, words), [1] * 60 + [0] * 60)
    for text in [*texts(20, 3, words, BAD), "", "a", "ab", "a b", "Élan élan", "one, two... THREE!! four-five six", "x" * 300, " ".join(words[:9])]:
        assert abs(model.score(text.encode()) - plain_score(model, text)) < 1e-5, text


def test_the_second_label_shapes_the_embeddings_too():
    words = vocabulary()
    some = texts(80, 1, words, BAD) + texts(80, 2, words) + texts(80, 3, words, ["brillig"]) + texts(80, 4, words, [*BAD, "brillig"])
    toxic, side = [1] * 80 + [0] * 160 + [1] * 80, [0] * 160 + [1] * 160
    model = toxicity.train(some, toxic, side)
    energy = np.linalg.svd(model.embeddings, compute_uv=False) ** 2
    assert energy[0] / energy.sum() < 0.9 and energy[1] / energy.sum() > 0.05
    held = texts(60, 5, words, BAD), texts(60, 6, words, ["brillig"])
    assert sum(model.score(t.encode()) >= 0.7 for t in held[0]) >= 56
    assert sum(model.score(t.encode()) >= 0.7 for t in held[1]) <= 3
    part = toxicity.train(some, toxic, [-1] * 40 + side[40:])  # unknown for some
    assert part.score(held[0][0].encode()) >= 0.7


def test_strange_columns(spark):
    words = vocabulary()
    rows = [(i, t, i, "x") for i, t in enumerate(texts(40, 7, words, BAD) + texts(40, 8, words))] + [(90, None, 0, "x"), (91, "", 0, "x"), (91, "", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE int, Text string")
    labels = spark.createDataFrame([(i, int(i < 40), i % 2) for i in range(80)], "doc_id long, toxic int, quality int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {90, 91} <= {r.doc_id for r in kept.collect()}
    assert sum(r.doc_id == 91 for r in kept.collect()) == 2
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_rows_without_an_id_are_not_held_out(spark, tmp_path):
    words = vocabulary()
    rows = list(enumerate(texts(40, 7, words, BAD) + texts(40, 8, words))) + [(None, "grumbolt"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40)) for i in range(80)] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op6_subword_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 82 and [r.held_out for r in got if r.doc_id is None] == [False, False]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
