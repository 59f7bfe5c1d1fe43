"""From raw documents to training tokens: toxic documents go, one document of each group of near
duplicates stays, personal data is masked, sources are mixed to their weights, and the mix is
encoded. Each stage works on all that the one before it kept.

Every text is handed on whole: of the one in which a source's budget ends, the mix takes all or
nothing, whichever is nearer to the target.

Every stage reads and writes the columns of documents (doc_id, text, lang, source, n_chars), and
passes extra columns through, also ones whose names differ from these in case only. An empty table
stays empty. What a stage does with nulls, ties and repeated rows is in its docstring."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, mixing, pii, simhash, toxicity
from orrery.llm.common import checkpoint_dir, pick, table


def _recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as the text now has them; by position, as other columns may be named alike."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, count = f"c{names.index('text')}", names.index("n_chars")
    return flat.withColumn(f"c{count}", F.char_length(text).cast("long")).toDF(*names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is below the threshold. Null and empty texts hold no word and stay;
    of repeated rows all stay or none; a text of any length is scored whole."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least doc_id. Texts without words
    are one group; of rows that share a doc_id one stays; rows without one link with nothing."""
    return simhash.drop_near_duplicates(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data in the text replaced by its kind in brackets.
    Null texts stay null; repeated rows are masked alike."""
    return _recounted(pii.mask_texts(docs, pii.fit(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole. Documents without words stay once; a null source is a source; equal keys are ordered by doc_id and text,
    and of equal rows as many are taken as the budget has room for."""
    return _recounted(mixing.mixed_texts(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and source of each text of the mix, its tokens (little-endian unsigned 32-bit), their
    number, and digests of the tokens and of what they decode to. Null texts have no tokens."""
    path, pattern = bpe.vocabulary()
    coded = bpe.code_texts(pick(docs, doc_id="doc_id", source="source", text="text"), path, pattern)
    return coded.select(
        "doc_id", "source", "tokens",
        F.expr("octet_length(tokens) div 4").cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: The stages' models and hashes are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _removed(spark: SparkSession, path: str) -> None:
    """Delete a stage's files, wherever they are; by the JVM's file systems, so not over Spark Connect."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result for sf_dir's documents; what a stage keeps is written as Parquet into
    the shared folder and read from there by the next. A stage's files go once the next one's are
    written; the last ones stay, as the result is read from them."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
