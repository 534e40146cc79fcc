"""A corpus pipeline from the operators of pointweave.llm: filter, deduplicate, redact, mix, pack.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a DataFrame; all but the
last return the columns of documents (doc_id, text, lang, source, n_chars). Columns that docs lacks are treated as null,
further ones are dropped. Null ids, texts, languages and sources, empty tables and repeated rows pass through every stage as
the operators define them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import mixing, neardup, packing, quality, secrets
from pointweave.llm._common import cut, session, table

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from the labels of the documents given."""
    docs = _documents(docs)
    model = quality.learn(docs, table(session(spark), sf_dir, "labels").withColumn("label", F.col("quality")))
    return quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: the one with the least (doc_id, hash of id and text), null ids last.

    Rows that agree in id and text (null and empty alike) are one document: a text that is not null goes before null, then the
    least lang, source and n_chars stand, nulls first.
    """
    session(spark)
    docs = _documents(docs)
    # rows are told apart by id and text, since ids can repeat or be null
    mark = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))), 256)
    marked = docs.withColumn("mark", mark)
    classes = neardup.classes(marked, keep=["mark"])
    best = classes.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("best")).select(F.col("best.mark").alias("mark"))
    kept = marked.join(cut(best), "mark", "left_semi")
    one = F.min(F.struct(F.col("text").isNull(), "lang", "source", "n_chars", "text")).alias("one")
    return kept.groupBy("mark").agg(F.first("doc_id").alias("doc_id"), one).select("doc_id", "one.text", "one.lang", "one.source", "one.n_chars")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by <SECRET>; n_chars follows."""
    session(spark)
    docs = _documents(docs)
    clean = secrets.scan(docs, keep=["doc_id", "lang", "source"], dictionary=secrets.learned(docs))
    return clean.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources reach their target weights; a document cut by the mix gives its first words."""
    session(spark)
    return mixing.mixed(_documents(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences; a row per piece."""
    session(spark)
    return packing.pack(_documents(docs))


STAGES = [("quality classifier", classify), ("near duplicates", deduplicate), ("secret scan", redact), ("source mix", mix), ("best-fit packing", pack)]

#: No stage of the list but the base patterns of the secret scan can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as a Parquet table and read again; a stage's input goes then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        name = f"pipeline_{uuid.uuid4().hex}_{i}"
        stage(spark, docs, sf_dir).write.format("parquet").saveAsTable(name)
        docs = spark.table(name)
        if before:
            spark.sql(f"DROP TABLE {before}")
        before = name
    return docs
