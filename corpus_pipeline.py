"""A corpus pipeline of five stages: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import mixing, packing, pii, quality, simhash
from larkspur.llm.queries import tokenizer_path
from larkspur.session import own_path, remove, stored, table, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker predicts to be good."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score, kept = unused(docs.columns, "score", "kept")
    return quality.score(docs, model, own=(score, kept)).filter(f"`{kept}` = 1").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of it."""
    return mixing.Mix(docs).texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence."""
    return packing.pack(docs, tokenizer_path()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Several stages (a trained ranker, XXH64, seeded draws, BPE) have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again. A stage's table goes once the
    next one's is written."""
    docs, paths = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        paths.append(own_path(spark, "stage-" + name.replace(" ", "-")))
        docs = stored(stage(spark, docs, sf_dir), paths[-1])
        if len(paths) > 1:
            remove(spark, paths[-2])
    return STAGES[-1][1](spark, docs, sf_dir)
