"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import append_columns, as_bytes, cut, pick, table

#: Ranges of the sampling key in each source; only the range that the budget ends in is sorted.
KEY_RANGES = 4096
#: A source is used at most so many times over.
MAX_EPOCHS = 3
#: Sources up to this number (a row of about 100 bytes each) are broadcast; beyond it they are joined.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"

DRAWN = [
    T.StructField("_size", T.LongType()),
    T.StructField("_key", T.DoubleType()),
    T.StructField("_range", T.IntegerType()),
    T.StructField("_tie", T.LongType()),
]


def quality(words: list[bytes]) -> float:
    """0.5 to 1: half plus half the share of distinct words, so that repetitive texts weigh less."""
    return 0.5 + 0.5 * len(set(words)) / len(words) if words else 1.0


def draw(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """Size, key -ln(u)/quality, its range and a tie-break of every row. u is a hash of the id."""
    sizes, keys, ties = [], [], []
    for doc_id, text in zip(ids.to_pylist(), as_bytes(texts), strict=True):
        words = text.split()
        digest = hashlib.md5(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        u = (int(digest[:13], 16) + 0.5) / 4503599627370496.0
        sizes.append(len(words))
        keys.append(-math.log(u) / quality(words))
        ties.append(zlib.crc32(text))
    # near to even ranges for the weights 0.5 to 1
    ranges = np.minimum(((1 - np.exp(-0.75 * np.array(keys))) * KEY_RANGES).astype(np.int32), KEY_RANGES - 1)
    return [pa.array(sizes, pa.int64()), pa.array(keys, pa.float64()), pa.array(ranges, pa.int32()), pa.array(ties, pa.int64())]


def targets(by_source: DataFrame, weights: Sequence[int], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Each source's share of all words by weight, stopped at max_epochs times its words; the
    excess goes to the others by weight until none is above. by_source: _source, _words.

    Sources ordered by max_epochs * words / weight reach their stop in this order while the level
    of the others rises, so running sums over them find who stops; the tests are on integers.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    table_of = F.array(*[F.lit(int(w)) for w in weights])
    src = by_source.select("_source", "_words", F.get(table_of, (rank % len(weights)).cast("int")).cast("long").alias("w"))
    src = src.withColumn("stop", F.col("_words") * max_epochs)
    everything = Window.partitionBy()
    earlier = Window.orderBy(F.col("stop") / F.col("w"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    src = src.select(
        "*",
        F.sum("_words").over(everything).alias("total"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("stop").over(earlier), F.lit(0)).alias("stopped"),
        F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("gone_w"),
    )
    src = src.withColumn("stops", (F.col("total") - F.col("stopped")) * F.col("w") > F.col("stop") * (F.col("all_w") - F.col("gone_w")))
    left = F.col("total") - F.sum(F.when(F.col("stops"), F.col("stop")).otherwise(0)).over(everything)
    left_w = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("w"))).over(everything)
    src = src.select("*", left.alias("left"), left_w.alias("left_w"))
    whole = F.when(F.col("stops"), F.col("stop")).otherwise(F.expr("try_divide(w * left, left_w)"))
    words = F.when(F.col("stops"), F.col("stop")).otherwise(F.expr("(w * left) div nullif(left_w, 0)"))
    return src.select("_source", "_words", whole.cast("double").alias("_target"), F.coalesce(words, F.lit(0)).cast("long").alias("_due"))


def ends(small: DataFrame, weights: Sequence[int], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """For each source (_at): its words, target, whole epochs, and the document in which the rest
    of its words ends: where it stands in the order (_end: key, id, tie), the words that it and
    rows equal to it have to give (_room) and how many such rows there are (_equal). A source that
    has no rest has no such document. small: _id, _source and the drawn columns."""
    sums = small.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum"))
    due = targets(sums.groupBy("_source").agg(F.sum("_sum").alias("_words")), weights, max_epochs)
    epochs = F.least(F.coalesce(F.expr("_due div nullif(_words, 0)"), F.lit(0)), F.lit(max_epochs)).cast("long")
    due = due.withColumn("_epochs", epochs).withColumn("_rest", F.col("_due") - F.col("_epochs") * F.col("_words"))
    due = due.withColumnRenamed("_source", "_at")
    running = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(running), F.lit(0)))
    same = F.col("_source").eqNullSafe(F.col("_at"))
    ending = sums.join(due.select("_at", "_rest"), same).where("_before < _rest AND _rest <= _before + _sum")
    ending = ending.select("_at", F.col("_range").alias("_last"), (F.col("_rest") - F.col("_before")).alias("_left"))
    # equal rows are one in what is sorted
    inside = small.join(ending, same & (F.col("_range") == F.col("_last")))
    inside = inside.groupBy("_at", "_key", "_id", "_tie", "_size", "_left").agg(F.count("*").alias("_equal"))
    order = Window.partitionBy("_at").orderBy("_key", "_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_room", F.col("_left") - F.coalesce(F.sum(F.col("_equal") * F.col("_size")).over(order), F.lit(0)))
    end = inside.where("0 < _room AND _room <= _equal * _size")
    end = end.select(F.col("_at").alias("_of"), F.struct("_key", "_id", "_tie").alias("_end"), "_room", "_equal")
    return due.join(end, F.col("_at").eqNullSafe(F.col("_of")), "left").select(
        "_at", F.col("_words").alias("_source_size"), "_target", "_epochs", "_end", "_room", "_equal"
    )


def take(drawn: DataFrame, due: DataFrame) -> DataFrame:
    """drawn (_id, _source and the drawn columns, besides others) with _source_size, _target and
    _taken. Where the document in which a source ends has equals, these are numbered: so many are
    taken whole, one in part, and the others not."""
    due = F.broadcast(due) if due.count() <= BROADCAST_SOURCES else due
    joined = drawn.join(due, F.col("_source").eqNullSafe(F.col("_at")))
    here = F.struct("_key", "_id", "_tie")
    part = F.when(here < F.col("_end"), F.col("_size")).when(here == F.col("_end"), F.least("_room", "_size")).otherwise(F.lit(0))
    out = joined.withColumn("_part", part)
    if not due.where("_equal > 1").isEmpty():
        several = F.coalesce((here == F.col("_end")) & (F.col("_equal") > 1), F.lit(False))
        number = F.row_number().over(Window.partitionBy("_at").orderBy("_key")) - 1
        numbered = joined.where(several).withColumn("_part", F.greatest(F.lit(0), F.least("_size", F.col("_room") - number * F.col("_size"))))
        out = out.where(~several).unionByName(numbered)
    taken = (F.col("_epochs") * F.col("_size") + F.col("_part")).cast("long").alias("_taken")
    return out.select(*drawn.columns, "_source_size", "_target", taken)


def drawn_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """_id, _source and the drawn columns of every row, without its text; kept, as the sums, the
    order inside the last ranges and the result all start from them."""
    few = pick(docs, _id=id_col, _text=text_col, _source=source_col)
    return cut(append_columns(few, ["_id", "_text"], draw, DRAWN, drop=["_text"]))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """docs with _size, _source_size, _target and _taken: the words of each row that the mix takes.

    A source whose target is e epochs and a rest takes every document e times, then its documents
    in the order of their keys until the rest is used up; the one in which it ends is taken in
    part (its first words). Keys are exponential draws divided by the document's quality, drawn
    from the id, so reruns agree. Documents are summed by source and range of the key (combined
    map-side); only the one range per source in which the budget ends is sorted, so a source with
    a great share of all rows doesn't meet in one task. The texts stay where they are: they are
    read once to draw and once more to be handed on with what is taken of them.

    Null texts have size 0; a null source is a source of its own, last in order; equal keys are
    ordered by id and text, and equal rows are interchangeable. No rows in, no rows out. Other
    columns, whatever their names, pass through in front.
    """
    width = len(docs.columns)
    due = cut(ends(drawn_rows(docs, id_col, text_col, source_col), weights, max_epochs))
    flat = docs.toDF(*[f"c{i}" for i in range(width)])
    id_at, text_at, source_at = (f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col))
    drawn = append_columns(flat, [id_at, text_at], draw, DRAWN)
    found = take(drawn.select("*", F.col(id_at).alias("_id"), F.col(source_at).alias("_source")), due)
    found = found.select(*[f"c{i}" for i in range(width)], "_size", "_source_size", "_target", "_taken")
    return found.toDF(*docs.columns, "_size", "_source_size", "_target", "_taken")


def allotment(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """_id, _source, _size, _source_size, _target and _taken of every row, as mix() has them, in
    one pass over the texts. Nulls, ties, equal rows and empty tables are as there; extra columns
    are ignored."""
    small = drawn_rows(docs, id_col, text_col, source_col)
    found = take(small, cut(ends(small, weights, max_epochs)))
    return found.select("_id", "_source", "_size", "_source_size", "_target", "_taken")


def mixed_texts(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of docs: each row as often as it is taken, whole every time. Of
    the one in which a source's budget ends, the part that is taken is handed on as the whole text if
    it is half of it or more, and else not at all, so a source misses its target by half a text at most.
    Documents without words (null, empty or blank texts), of which any number is in keeping with the
    targets, stay once. Of equal rows as many are handed on as the mix takes; an empty table stays
    empty; other columns pass through, whatever their names."""
    width, names = len(docs.columns), docs.columns
    flat = mix(docs, text_col=text_col, **options).toDF(*[f"c{i}" for i in range(width)], "size", "source_size", "target", "taken")
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("(2 * taken + size) div greatest(2 * size, 1)"))
    flat = flat.withColumn("times", times.cast("int")).where("times > 0")
    flat = flat.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return flat.select(*[f"c{i}" for i in range(width)]).toDF(*names)


def op5_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allotment(table(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"),
    )
