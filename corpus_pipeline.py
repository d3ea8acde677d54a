"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Between stages the documents are written as Parquet and read again, so a lost executor never
costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import line_crf, mixing, phrases, pieces, simhash
from loomgraph.llm.common import shared_dir, table, written
from loomgraph.llm.queries import PIECE_MODEL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    return line_crf.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles) the document with the smallest id stays."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words that an earlier document has are cut out."""
    return phrases.Repeats(docs).documents()


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics have their target shares of tokens."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, and whether they read back as the text."""
    model = pieces.Model.read(PIECE_MODEL)
    back = pieces.encoded_and_decoded(docs, model)
    return back.selectExpr("doc_id", "cast(size(ids) as bigint) AS n_ids", "ids", "decoded = text AS round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixing to target weights", mixing_to_targets),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    path = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, path, f"stage{i}")
    return docs


#: Near-duplicate fingerprints and line labels have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
