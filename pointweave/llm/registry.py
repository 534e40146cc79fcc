"""The queries opN_<name>: thin wrappers that apply each operator to its whole table and derive the contract's columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fm_dedup, langid, lcp, merkle, mixing, neardup, packing, quality, rules, secrets, suffix_dedup, tokenfile, upsert
from ._common import fold, session, shared_folder, table
from .oracles import ORACLES as ORACLES


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited version, and their likeness to those of the next document."""
    return lcp.edited_pairs(table(session(spark), sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and novel secret spans of every text."""
    docs = table(session(spark), sf_dir, "documents")
    return secrets.scan(docs, keep=["doc_id"], dictionary=secrets.learned(docs)).drop("redacted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and the verdict of the risk-controlled rules, by language."""
    docs, labels = table(session(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rules.verdicts(docs, labels)


def op4_bagminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, named by its least doc_id."""
    return neardup.classes(table(session(spark), sf_dir, "documents")).select("doc_id", "class_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the byte strings that smaller documents have too."""
    return suffix_dedup.remove(table(session(spark), sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    return mixing.mix(table(session(spark), sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", F.get("places", F.lit(0)).alias("place"))


def op7_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the word windows that start earlier, too."""
    return fm_dedup.remove(table(session(spark), sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens."""
    return packing.pack(table(session(spark), sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from two folds of three."""
    docs = table(session(spark), sf_dir, "documents")
    held = fold(3) == 1
    prototypes = langid.learn(docs, ~held)
    return langid.predict(docs.withColumn("held_out", held), prototypes, ["doc_id", "held_out"])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every text, learned from three folds of four."""
    docs, labels = table(session(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(4) == 2
    model = quality.learn(docs, labels.where(~held).withColumn("label", F.col("quality")))
    scored = quality.score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether a third of the documents passes after tampering."""
    return merkle.verified(table(session(spark), sf_dir, "documents"), fold(3) == 0)


def _crc(*columns: str):
    return F.crc32(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary"))


def op12_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes part of clients as sorted files, applies each client's last change to them, and reports on the files there are then."""
    clients, changes = table(session(spark), sf_dir, "clients"), table(spark, sf_dir, "client_changes")
    folder, size, sets = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}", upsert.per_file(clients.count()), ["source", "segment", "city", "balance"]
    upsert.start(clients.where(_crc("client_id") % 7 > 3), "client_id", size, folder)

    def decide(first):
        h = F.crc32(first.cast("string").cast("binary")) % 12
        return h <= 7, F.coalesce(F.col("__c.op") == "D", F.lit(False)) | (_crc("__c.change_id") % 8 < h)

    last = upsert.latest(changes.select("client_id", "seq", "change_id", "op", *sets), "client_id", ["seq", "change_id"])
    upsert.upsert(spark, folder, "client_id", size, last, sets, decide)
    cents = F.coalesce(F.floor(100 * F.col("balance") + 0.5), F.lit(0)).cast("long")
    return upsert.report(spark, folder, "client_id", {"cents": cents, "rows_crc": _crc("source", "segment", "city")})


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all ids, compressed by Re-Pair, into a new folder, and reads every document's back."""
    return tokenfile.index(spark, tokenfile.write(table(session(spark), sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_secrets": op2_secrets,
    "op3_quality_rules": op3_quality_rules,
    "op4_bagminhash_neardup": op4_bagminhash_neardup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_mixing": op6_mixing,
    "op7_fm_dedup": op7_fm_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_upsert": op12_upsert,
    "op13_token_ids": op13_token_ids,
}
