import hashlib
import random

import corpus_pipeline
from orrery.llm import bpe, pii, toxicity
from tests.llm.test_simhash import plain_fingerprint, smallest_reachable


def test_stages_equal_a_plain_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 500)
    draw = random.Random(3)
    words = ["".join(draw.choices(["ta", "ren", "mi", "kol", "us", "ber"], k=draw.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(240):
        own = draw.choices(words, k=draw.randint(40, 120))
        if i % 4 == 0:
            own[5] = own[20] = "grumbolt"
        if i % 5 == 0:
            own[10] = f"me{i}@mail.example.com"
        rows.append([i, " ".join(own), "en", f"src{i % 3}", 0])
    rows += [[1000 + i, rows[i][1].replace(" ", "  ", 1), "en", "src0", 0] for i in range(30)]
    rows += [[2000, "", "en", None, 0], [2001, None, "en", "src1", 0]]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    plain = [r for r in rows if model.score((r[1] or "").encode()) < 0.7]
    assert {r[0] for r in plain} >= {r[0] for r in rows if "grumbolt" not in (r[1] or "")}
    assert sum("grumbolt" in (r[1] or "") for r in plain) <= 3
    prints = [plain_fingerprint(r[1]) for r in plain]
    order = sorted(range(len(plain)), key=lambda k: plain[k][0])
    group = smallest_reachable(len(order), lambda i, j: (prints[order[i]] ^ prints[order[j]]).bit_count() <= 3)
    plain = [plain[order[k]] for k in sorted(set(group))]

    kept = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in plain]
    masked = corpus_pipeline.STAGES[2][1](spark, kept, str(tmp_path))
    assert masked.columns == docs.columns
    texts = {r.doc_id: r.text for r in masked.collect()}
    for r in plain:
        base = pii.base_spans(r[1] or "")
        assert texts[r[0]] == (r[1] and pii.mask(r[1], base))

    mixed = corpus_pipeline.STAGES[3][1](spark, masked, str(tmp_path))
    assert mixed.columns == docs.columns
    ranks = bpe.read_ranks(bpe.vocabulary()[0])
    tokenizer = bpe.Tokenizer(ranks, bpe.compile_merges(ranks), bpe.vocabulary()[1])
    sizes, taken, want = {}, {}, []
    for r in plain:
        sizes[r[3]] = sizes.get(r[3], 0) + len((texts[r[0]] or "").split())
    for r in mixed.collect():
        assert texts[r.doc_id] == r.text and r.n_chars == (None if r.text is None else len(r.text))
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
        raw = b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(r.text or ""))
        want.append((r.doc_id, hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    total = sum(sizes.values())  # src0, src1 and src2 weigh 1, 2, 3, the source without a name 1 but it has no words
    assert sizes.pop(None) == taken.pop(None) == 0
    longest = max(len((t or "").split()) for t in texts.values())
    assert all(abs(taken[f"src{k}"] - total * (k + 1) / 6) <= longest / 2 + 1 for k in range(3))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(want)


def test_no_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 10)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_strange_rows_pass_all_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pii, "STEPS", 200)
    draw = random.Random(5)
    words = ["".join(draw.choices(["ta", "ren", "mi", "kol", "us", "ber"], k=draw.randint(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(draw.choices(words, k=60)), "en", f"src{i % 2}", 0, "X", i) for i in range(40)]
    rows += [rows[3]] * 5 + [(None, "null id " + " ".join(words[:30]), None, None, None, None, None)] * 2
    rows += [(100, " ".join(draw.choices(words, k=150_000)), "en", "src0", 0, "X", 1), (101, None, "en", "src1", 0, "X", 1), (102, "", "en", "src1", 0, "X", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, N_CHARS int"
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.createDataFrame(rows, schema).repartition(3)
        spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, str(tmp_path)).cache()
            assert docs.columns == columns, name
            assert docs.count() > 0
        found = docs.collect()
        assert all(r[5] in ("X", None) and r[4] == (None if r[1] is None else len(r[1])) for r in found)
        assert sum(r[0] is None for r in found) in range(0, 7)
        out = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
        assert sorted(map(str, (r.doc_id for r in out))) == sorted(map(str, (r[0] for r in found)))
        by_text = {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in found}
        assert {r.decoded_sha256 for r in out} == by_text
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
