"""The registered corpus queries: each applies one operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import chat, kneser_ney, licenses, line_crf, mixing, phrases, pieces, random_indexing, simhash, telephony
from loomgraph.llm.common import table


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.text_media(table(spark, sf_dir, "documents"))


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.line_quality(table(spark, sf_dir, "documents"))


#: A public vocabulary with byte fallback; read on the driver only.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op3_pieces(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    """Ids of every whole text, read back into text."""
    model = pieces.Model.read(model_path)
    back = pieces.encoded_and_decoded(table(spark, sf_dir, "documents"), model)
    return back.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op4_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.Repeats(table(spark, sf_dir, "documents")).report()


def op5_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.chances(table(spark, sf_dir, "documents"))


def op8_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op9_chat_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts are control strings of a common template."""
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.formatted(rows), in_order=True)


def op10_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return random_indexing.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_telephony": op1_telephony,
    "op2_line_crf": op2_line_crf,
    "op3_pieces": op3_pieces,
    "op4_phrase_automata": op4_phrase_automata,
    "op5_ball_hashing": op5_ball_hashing,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_raking": op7_raking,
    "op8_license_join": op8_license_join,
    "op9_chat_assembly": op9_chat_assembly,
    "op10_random_indexing": op10_random_indexing,
}

ORACLES: dict[str, str] = {
    "op7_raking": mixing.SQL,
    "op8_license_join": licenses.SQL,
    "op9_chat_assembly": chat.SQL,
}
