from pyspark.sql import functions as F

from orrery.llm import mixing


def rows_of(spark, rows, columns="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, columns)


def test_targets_epochs_and_reruns(spark):
    rows = [(i, "a b c " * (1 + i % 7), s) for i, s in enumerate(["a"] * 40 + ["b"] * 5 + ["c"] * 90 + [None] * 20)]
    docs = rows_of(spark, rows).repartition(3)
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in mixing.mix(docs.repartition(7)).collect())
    total = sum(r["_size"] for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], {"size": 0, "taken": 0, "target": r["_target"], "given": r["_source_size"]})
        s["size"] += r["_size"]
        s["taken"] += r["_taken"]
        assert 0 <= r["_taken"] <= 3 * r["_size"]
    assert abs(sum(s["target"] for s in by.values()) - total) < 1e-6
    for s in by.values():
        assert s["given"] == s["size"] and abs(s["taken"] - s["target"]) < 1 and s["target"] <= 3 * s["size"]
    assert by["b"]["target"] == 3 * by["b"]["size"]  # stopped, as a third of all words is more
    # the excess goes to the others by their weights: a 1, c 3, null 1
    left = total - by["b"]["target"]
    assert abs(by["a"]["target"] - left / 5) < 1e-6 and abs(by["c"]["target"] - left * 3 / 5) < 1e-6


def test_the_texts_of_the_mix_are_whole(spark):
    rows = [(i, f"w{i}  x\ty " * (1 + i % 5), s) for i, s in enumerate("aabbbbbbbbbbbcccc")] + [(90, None, "a"), (91, " ", "c")]
    docs = rows_of(spark, rows)
    taken = {r.doc_id: r._taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
        assert r.text == rows[[x[0] for x in rows].index(r.doc_id)][1]
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    times = {k: (2 * taken[k] + n) // (2 * n) if n else 1 for k, n in size.items()}  # the nearest whole number
    assert any(taken[k] % n for k, n in size.items() if n)
    assert {k: times[k] * size[k] for k in size if times[k]} == words


def test_strange_tables(spark):
    assert mixing.mix(rows_of(spark, [], "doc_id long, text string, source string")).count() == 0
    same = [(None, None, None), (None, "", None), (1, "a b", ""), (1, "a b", ""), (1, "a b", "")]
    got = mixing.mix(rows_of(spark, same)).collect()
    assert len(got) == 5 and sum(r._taken for r in got) == 6
    clash = spark.createDataFrame([(1, "a b", "s", 5, 6)], "doc_id long, text string, source string, SOURCE int, w int")
    out = mixing.mix(clash)
    assert out.columns[:5] == clash.columns and out.collect()[0][-1] == 2
    long = rows_of(spark, [(1, "word " * 200_000, "a"), (2, "b", "b")])
    assert {r.doc_id: r._taken for r in mixing.mix(long).collect()} == {1: 199_998, 2: 3}


def test_allotment_equals_the_mix_of_the_texts(spark):
    rows = [(i % 37, "a b c " * (1 + i % 7), s) for i, s in enumerate(["a"] * 40 + ["b"] * 5 + ["c"] * 90 + [None] * 20)]
    docs = rows_of(spark, rows).repartition(3)
    full = mixing.mix(docs).select("doc_id", "source", "_size", "_source_size", "_target", "_taken").collect()
    assert sorted(map(str, map(tuple, full))) == sorted(map(str, map(tuple, mixing.allotment(docs).collect())))


def test_the_budget_may_end_in_equal_rows(spark):
    same = [(7, "a b c", "x")] * 50 + [(8, "a b c d", "y")] * 90 + [(None, "q", None)] * 10
    got = mixing.allotment(rows_of(spark, same).repartition(5)).collect()
    by = {}
    for r in got:
        taken, target = by.setdefault(r._source, ([], r._target))
        taken.append(r._taken)
        assert r._taken <= 3 * r._size
    for source, (taken, target) in by.items():
        assert abs(sum(taken) - target) < 1, source
        size = {"x": 3, "y": 4, None: 1}[source]
        assert sum(t % size != 0 for t in taken) <= 1  # one in part at most
