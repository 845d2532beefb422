"""One query for each operator of this subpackage, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hilbert, mixing, packing, pii_semicrf, rans, secret_crf, simhash, tiff, toxicity
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(documents(spark, sf_dir))


def op2_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_crf.scan(documents(spark, sf_dir))


def op3_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.read_back(chat.windows(turns))


def op6_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_pii_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_semicrf.scan(documents(spark, sf_dir))


def op8_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_files(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    every = (
        op1_tiff_media,
        op2_secret_crf,
        op3_hilbert_search,
        op4_toxicity_kneser_ney,
        op5_chat_windows,
        op6_karmarkar_karp_packing,
        op7_pii_semi_crf,
        op8_water_filling_mix,
        op9_simhash_pigeonhole,
        op10_token_rans,
        pipeline,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_windows": chat.ORACLE, "op8_water_filling_mix": mixing.ORACLE}
