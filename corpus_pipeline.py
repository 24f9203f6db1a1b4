"""Corpus pipeline: language ID, near-dedup, personal data, mixing, packing. Each stage takes
(spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows and rereads them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import drop_stored, maybe_in, store
from pointloom.llm.langid import UNKNOWN, identify, train
from pointloom.llm.minhash import near_duplicates
from pointloom.llm.mixing import draw, mix
from pointloom.llm.packing import pack_documents
from pointloom.llm.pii import find_pii, redact
from pointloom.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the predicted language to lang and rejects documents without a letter, null and empty ones
    among them. Where no document has both a text and a language there is nothing to learn from:
    lang stays as it is, and the same documents go."""
    model = train(docs.select("doc_id", "text", "lang"))
    if model.languages == [UNKNOWN]:
        return docs.select(COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    return identify(docs.select(COLUMNS), model).where(F.col("lang_pred") != UNKNOWN).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies (five-word shingles,
    similarity 0.8). Documents without words stay, and so do rows without a doc_id. Of rows that repeat
    both doc_id and text one stays."""
    found = near_duplicates(docs.select("doc_id", "text"))
    kept = docs.select(COLUMNS).join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)
    twice = store(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if not twice.limit(1).count():
        return kept
    some, rest = maybe_in(kept, ["doc_id"], twice)
    return rest.unionByName(some.dropDuplicates(["doc_id", "text"]))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind, and counts characters anew. Null texts stay null,
    texts without personal data stay as they are, repeated rows stay repeated."""
    found = find_pii(docs.select(COLUMNS)).withColumn("text", redact(F.col("text"), F.col("pii")))
    return found.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources towards even weights, none more than twice as often as
    another; every document is drawn at least once. Null sources are one source, null texts have no tokens."""
    return draw(mix(docs.select(COLUMNS), repeat_limit=2.0), COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset. A null text is empty, one piece with the end id alone;
    each repetition of a row has pieces of its own; an empty table has none."""
    return pack_documents(docs, "pipeline-pieces")


def _sent(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language ID", _sent(identify_language)),
    ("MinHash near-dedup", _sent(drop_near_duplicates)),
    ("PII", _sent(redact_personal_data)),
    ("mixing sources to target weights", _sent(mix_sources)),
    ("best-fit packing", _sent(pack_sequences)),
]

# Language ID is a trained network: SQL can't express it. tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
        drop_stored(docs)
        docs = made
    return docs
