"""From raw documents to packed sequences: each stage's rows are written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir); all but the last return the columns
of documents.

toxicity       documents predicted toxic go
near_dedup     one document of each near-duplicate component stays, that of the smallest doc_id
secrets        secrets in the texts are replaced by [SECRET]
mixing         rows as often as the mix takes them; where a source's fractional repetition ends, a document's first words
packing        one row per piece, with its place in a sequence of at most 2048 tokens

Defined results: a null or empty text is scored as one without words, is linked
with other wordless texts (one of them stays), holds no secret, takes no part
in the mix and so reaches no window; a null source is a source of its own; rows
of equal texts are one component, whatever their ids; a very long text is read
whole by each stage and cut into whole windows last; an empty table gives an
empty one; other columns of documents, also with names that stages use
themselves, come through all stages but the last.

Stages can't be expressed in SQL (models, fingerprints, tokenizer), so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import mixing, packing, secret_crf, simhash, toxicity
from corvane.llm.common import documents, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_crf.redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, table_bytes=TABLE_BYTES)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None

#: Workers that pack have run the other stages before, and keep their tables of words: smaller ones than packing alone takes.
TABLE_BYTES = 24 << 20


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
