"""A training-corpus pipeline over the documents table: five stages, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.llm import decontam, jaccard, language, packing, pii
from costweave.llm.shared import free_name, table
from costweave.session import setting, shared_folder, store


BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500  # rows that go to a Python worker at once: bounds what it and its executor hold of them


def bound_batches(spark: SparkSession) -> None:
    """From now on Python workers get at most BATCH_ROWS rows at once.

    It stays set, as a stage's rows are only worked on when its caller writes them; run() puts back what was set before.
    """
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go: NULL texts and texts without a letter.

    The model learns from the documents that are not held out; with no labelled document all are kept that
    have a letter. Rows keep their columns; repeated rows are treated alike.
    """
    bound_batches(spark)
    model = language.train(docs.where(~language.held_out()))
    if model is None:
        letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        return docs.where(letter)
    found = free_name(docs, "_language")
    marked = docs.withColumn(found, language.language_of(model, "text")["lang"])
    return marked.where(F.col(found) != language.UNKNOWN).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id: five-word shingles, similarity 0.8 or more."""
    bound_batches(spark)
    return jaccard.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or edited, go."""
    bound_batches(spark)
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks of its kind; no document goes."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids, each with its sequence and offset."""
    bound_batches(spark)
    return packing.pack_documents(docs, remembered=100_000)  # some 5 MB a worker, which has served the other stages, too


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", redact_personal_data),
    ("packing", pack_sequences),
]

#: trained models, alignment and tokens have no SQL form; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are stored in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    with setting(spark, BATCH_KEY, BATCH_ROWS):
        for number, (_, stage) in enumerate(STAGES):
            rows = stage(spark, docs, sf_dir)
            store(rows, f"{folder}/{number}")
            docs = spark.read.schema(rows.schema).parquet(f"{folder}/{number}")
    return docs
