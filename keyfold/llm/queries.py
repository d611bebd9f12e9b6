"""One query per operator, over its whole table."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import embeddings, linededup, mixing, packing, pieces, pii, quality, simhash, suffixes, warc
from keyfold.llm.shared import new_folder, staged

#: Vocabulary files of public tokenizers.
TOKENIZERS = "/opt/tokenizers"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark: SparkSession, d: str) -> DataFrame:
    ready = mixing.sized(_table(spark, d, "documents").select("doc_id", "text", "source"), power=0.25, seed=1)
    narrow = staged(ready.drop("text"), "sizes")
    out = mixing.copies(narrow, mixing.plan(narrow, weights=(1, 2, 3), most=3.0), most=3.0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "expected")


def op2_simhash(spark: SparkSession, d: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, d, "documents"), shingle=4, distance=4, prints=1, similarity=None)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, d: str) -> DataFrame:
    # a name that Spark hides in its pages and logs; without one, no later run can repeat or undo this one's surrogates
    key = spark.conf.get("spark.keyfold.pii.secret", None) or secrets.token_hex(32)
    return pii.replace(_table(spark, d, "documents").select("doc_id", "text"), key=key)


def op4_packing(spark: SparkSession, d: str) -> DataFrame:
    eos, length, folder = 50256, 2048, new_folder(spark, "packed")
    packed = packing.pack(_table(spark, d, "documents"), vocabulary=f"{TOKENIZERS}/byte_bpe_50k.tiktoken", eos=eos, length=length)
    return packing.read_binary(packing.write_binary(packed, folder, positions="resets"), folder, length=length, eos=eos)


def op5_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return pieces.encode(_table(spark, d, "documents"), model=f"{TOKENIZERS}/piece_bpe_32k.model", ranks=True)


def op6_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = suffixes.remove_repeats(_table(spark, d, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "text")


def op7_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, d, "pages"), new_folder(spark, "warc"), least=0)


def op8_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, d, "documents").select("doc_id", "text"))


def op9_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, d, "embeddings"), cosine=0.98)


def op10_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    out = quality.judged(docs.select("doc_id", "text"), quality.fit(docs, _table(spark, d, "labels")))
    return out.select("doc_id", *(F.col("counts")[c].alias(c) for c in quality.BASE), "base_failed", "rule", "kept")


_QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_warc": op7_warc,
    "op8_line_dedup": op8_line_dedup,
    "op9_embeddings": op9_embeddings,
    "op10_quality": op10_quality,
}
_SQL: dict[str, str] = {
    "op6_suffix_dedup": suffixes.SQL,
    "op7_warc": warc.SQL,
    "op8_line_dedup": linededup.SQL,
    "op9_embeddings": embeddings.SQL,
}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
