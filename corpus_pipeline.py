"""A corpus pipeline: five stages, each of which works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import linededup, mixing, pieces, quality, simhash
from keyfold.llm.queries import TOKENIZERS
from keyfold.llm.shared import last_staged, staged_folders, unwrapped, wrapped

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rules learned from the labels decide; what they or the base rules reject goes."""
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = quality.judged(wrapped(docs, "text"), rules).filter("kept")
    return good.select(*unwrapped(good))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; n_chars follows the text."""
    cut = linededup.dedup_lines(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8."""
    return simhash.one_of_each_group(docs, shingle=5, distance=10, prints=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.explode_copies(mixing.mix(wrapped(docs, "doc_id", "text", "source"), weights=(1, 2, 3), most=3.0, power=0.25, seed=1))
    return mixed.select(*unwrapped(mixed))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document."""
    return pieces.encode(docs, model=f"{TOKENIZERS}/piece_bpe_32k.model", ranks=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("line_dedup", cut_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: No stage but line dedup can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what the stages staged goes with their end."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_folders()
    for name, stage in STAGES:
        docs = last_staged(stage(spark, docs, sf_dir), f"stage-{name}", before)
    return docs
