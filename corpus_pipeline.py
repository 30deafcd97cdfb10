"""From raw documents to packed training sequences: five stages over whole tables.

Each stage gets all rows that the stage before it kept, and returns the columns of documents; the last returns pieces
of packed sequences. run() writes each stage's result to the shared folder and reads it back, so a lost executor never
sends the work back over a stage.

Defined results: a null or empty text passes as an empty one: of all empty texts the smallest doc_id stays, and is packed
as the end id alone. Rows without doc_id are never dropped as copies, rows that share one are told apart. Copies of one
text under the smallest doc_id all stay. Further columns pass through, whatever their names. Without labels nothing is
toxic. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import exact_dedup, mixing, packing, simhash, toxicity
from brindle.llm.common import materialise, table

#: A tenth of the tokens goes where sources exceed their weight; no document is taken twice. That keeps documents over
#: reaching the weights, which the budget exceeds in nearly every domain: the README has the shares reached.
MIX = mixing.MixConfig(share=(9, 10), max_epochs=1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    config = toxicity.ToxicityConfig()
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), config), config.threshold)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.select(docs, MIX)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The toxicity model, the fingerprints and the tokens are no SQL; test_pipeline holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
