"""The event ledger as a stream of segments, and edge weights kept up with it.

A ledger is JSON lines in files that are only ever added: a file stream doesn't see lines appended to a file it has
read, so every append is a new segment. Each micro-batch folds its updates, on the executors and in order, to one step
per edge (learning.weight_steps) and overwrites its own folder of steps, so a batch that is run again after a failure
leaves the same rows; across micro-batches the order is that of the segments. An edge's weight is its batches' steps
composed, from the weight it started with. Nothing of an edge's history is held in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import learning as L
from ..sources.storage import shared_path

UPDATE_SCHEMA = "source string, target string, relation string, reward double, eligibility double, confidence double, independence double, at long, seq long"
KEY = ["source", "target", "relation"]
STEP_SCHEMA = f"source string, target string, relation string, s {L.STEP}, up long, down long"


def append_segment(events: DataFrame, ledger: str) -> None:
    """Add events to the ledger as new files; summaries are clipped."""
    if "summary" in events.columns:
        events = events.withColumn("summary", F.left("summary", F.lit(C.SUMMARY_CHARS)))
    events.write.mode("append").json(ledger)


def stream_segments(spark: SparkSession, ledger: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """The ledger's segments as they come; a malformed line fails the stream."""
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.json(ledger)


def steps(spark: SparkSession, sink: str) -> DataFrame:
    """(key, s, up, down) of each edge over all batches in the sink."""
    rows = spark.read.schema(f"{STEP_SCHEMA}, batch int").parquet(sink)
    return L.compose(rows, KEY, "batch")


def replay(spark: SparkSession, ledger: str, edges: DataFrame, checkpoint: str | None = None, sink: str | None = None, per_batch: int | None = None) -> DataFrame:
    """Drain the ledger's new segments and give the edges (key, weight, success_count, failure_count) after all updates
    so far; edges are those at the ledger's beginning, updates of others do nothing. A checkpoint and sink that are given
    again resume."""
    checkpoint = checkpoint or shared_path(spark, "ledger-checkpoint")
    sink = sink or shared_path(spark, "ledger-steps")

    def save(batch: DataFrame, n: int) -> None:
        L.weight_steps(batch, KEY, ["at", "seq"]).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    query = stream_segments(spark, ledger, UPDATE_SCHEMA, per_batch).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.foreachBatch(save).start().awaitTermination()
    return L.apply_steps(edges, steps(spark, sink), KEY)
