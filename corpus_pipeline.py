"""The pipeline over documents: five stages, each written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, mixing, ngram_join, pii, toxicity
from panelspark.llm.common import discard, materialize


def _repeated(docs: DataFrame) -> bool:
    """Whether a doc_id has several rows; as a rule none has."""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model is learned from the labels and these documents.

    Each row is judged by its own text: rows alike fare alike, null and empty texts stay, rows of null doc_id teach nothing.
    Columns that the stage adds for itself have names that begin with two underscores and do not come back.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="__toxicity").where(F.col("__toxicity") < toxicity.THRESHOLD).drop("__toxicity")


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones stays: that of the smallest doc_id.

    Rows of one doc_id and text are one document, the least of them in the other columns; rows of one doc_id and different
    texts are documents of their own, in the order of their texts. Rows of null doc_id and texts without words stay.
    """
    if not _repeated(docs):
        return ngram_join.representatives(docs).select(*docs.columns)
    # A key for each document, ascending with doc_id and text.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("__none"), *others)).alias("__least"))
    named = named.select("doc_id", "text", *[F.col("__least").getField(c).alias(c) for c in others])
    named = materialize(named.orderBy("doc_id", "text").withColumn("__row", F.monotonically_increasing_id()), "ngram-keyed")
    kept = ngram_join.representatives(named, key="__row").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is put as [KIND]; n_chars is that of the new text, 0 for a null one. Every row stays, repeated ones too."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words are not taken.

    Where a doc_id has several rows, the whole row is the key, and rows alike in all columns are one, taken as often as all
    of them together. Which rows are taken grows with the table, so they meet the documents in a join by key, not by broadcast.
    """
    rows, key = docs, "doc_id"
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        key = "__row"
        rows = docs.withColumn(key, F.xxhash64(F.to_json(F.struct(*docs.columns))))
    times = mixing.mix(rows, key=key).where("times > 0").groupBy(F.col(key).alias("__taken")).agg(F.sum("times").alias("__times"))
    if key == "__row":
        rows = rows.dropDuplicates([key])
    taken = rows.join(times.hint("merge"), rows[key].eqNullSafe(times["__taken"])).drop("__taken")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text as tokens, with the digests of its ids and of the bytes decoded from them."""
    import public_tokenizers

    # Workers hold what the stages before have left of their heap: they remember fewer pieces than where this operator runs alone.
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, most=200_000)


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard", near_copies_out),
    ("pii", personal_data_out),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: Learned stages cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, the result of each but the last written and read again; what a stage has read goes once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
