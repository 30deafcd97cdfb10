"""Exact deduplication as a stateful stream without expiry.

Every row becomes (doc_id, digest, locator): the SHA-256 of its text with white-space runs replaced by one space, and
the file and row that hold it. The stream keeps, for each digest ever seen, the smallest stable identifier, its content
locator and a count, in a disk-backed (RocksDB) state store without watermark, so nothing is forgotten. Rows are
combined before the shuffle, so a digest that a third of all rows share sends one row per task.

A hit (a digest with more than one row) is checked on full bytes: the texts at the locators of its rows, and of the row
that the state holds for it, are fetched, and the smallest and the largest must be the same string. Only these texts
move. Digests that fail are grouped by (digest, full text) instead.

With a folder for the state, each run adds its rows to what earlier runs have seen: the stream reads new rows only, and
texts of earlier runs are fetched where their files lie. Without one, a run starts from nothing.

Defined results: a null text counts as empty; empty texts equal each other; ties in doc_id and repeated rows count as
further copies, and of rows that share the smallest doc_id each is marked kept; rows are told apart by their place, so
one doc_id with two texts counts as two; a row without doc_id counts as a copy but stays; an empty table gives an empty
result. In a run with a state, keep_id and group_size count all runs, and a row is kept if no run had a smaller doc_id.
DataFrame operations only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AT, FILE, PATH, SPACE, fresh_path, located, materialise, partitions, scratch, small, table

#: Files of earlier runs that are read by name at most; of more, their folders are.
MOST_FILES = 10_000


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


ROWS = "doc_id long, digest string, file long, at long"
STATE = "digest string, keep_id long, file long, at long, group_size long"


def digests(docs: DataFrame, digest=sha256_text) -> DataFrame:
    """(doc_id, digest, file, at) of located() rows."""
    return docs.select("doc_id", digest(normalised(docs["text"])).alias("digest"), F.col(FILE).alias("file"), F.col(AT).alias("at"))


def _first(*fields: str) -> Column:
    """The least of the rows that have an identifier; any row's locator where none has."""
    return F.min(F.struct(F.col(fields[0]).isNull().alias("none"), *fields)).alias("first")


def stream_state(stream: DataFrame) -> DataFrame:
    """Streaming aggregate of digests() rows: keep_id, its locator and group_size so far of each digest."""
    seen = stream.groupBy("digest").agg(_first("doc_id", "file", "at"), F.count(F.lit(1)).alias("group_size"))
    return seen.select("digest", F.col("first.doc_id").alias("keep_id"), "first.file", "first.at", "group_size")


def run_stream(spark: SparkSession, source: str, checkpoint: str, sink: str, max_files: int | None = None) -> DataFrame:
    """Feed all new files in source to the state, as a restartable availableNow query; the latest state of every digest seen.

    Each micro-batch overwrites its own folder of changed digests, so a batch that is run again after a failure leaves
    the same files. Counts only grow and identifiers only fall, so max and min over all batches give the latest state.
    """
    stream = spark.readStream.schema(ROWS)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    held = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        query = stream_state(stream.parquet(source)).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
        query.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    seen = spark.read.schema(f"{STATE}, batch int").parquet(sink)
    latest = seen.groupBy("digest").agg(_first("keep_id", "file", "at"), F.max("group_size").alias("group_size"))
    return latest.select("digest", "first.keep_id", "first.file", "first.at", "group_size")


#: State on local disk with checkpointed snapshots; memory of all stores of an executor bounded together.
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else each of many small stores reserves megabytes of disk
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _at_hand(docs: DataFrame, state: str | None) -> DataFrame:
    """docs with their places; what isn't a table yet is written, for later runs to read where they have a state."""
    return located(docs, "exact-docs", at=f"{state.rstrip('/')}/texts/{uuid.uuid4().hex}" if state else None)


def groups(docs: DataFrame, digest=sha256_text, state: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest, file, at. state: a shared folder that later runs give again."""
    spark = docs.sparkSession
    with scratch(spark):
        docs = _at_hand(docs, state)
        base = state.rstrip("/") if state else fresh_path(spark, "exact", mine=True)
        new = materialise(digests(docs, digest), "exact-rows", at=f"{base}/rows/{uuid.uuid4().hex}")
        files = f"{base}/files" if state else None
        if files:
            docs.select(F.col(FILE).alias("file"), F.col(PATH).alias("path")).distinct().write.mode("append").parquet(files)
        if new.isEmpty():
            return materialise(new.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "file", "at"), "exact-none", keep=True)
        held = materialise(run_stream(spark, f"{base}/rows/*", f"{base}/checkpoint", f"{base}/state"), "exact-state")
        marked = new.join(held.select("digest", "keep_id", "group_size", F.col("file").alias("keep_file"), F.col("at").alias("keep_at")), "digest")
        marked = materialise(marked, "exact-marked", keep=True)
        hot = (F.col("group_size") > max(1000, new.count() // 1000)).alias("hot")
        hits = marked.where("group_size > 1")
        places = hits.select("file", "at", hot)
        if state:
            places = places.unionByName(hits.select(F.col("keep_file").alias("file"), F.col("keep_at").alias("at"), hot)).distinct()
        texts = materialise(fetch(docs, places, digest, files), "exact-texts")
        failed = materialise(differing(texts), "exact-failed")
        if not failed.isEmpty():
            rows = marked.select("doc_id", "digest", "file", "at").join(failed, "digest", "left_semi")
            if state:
                rows = materialise(spark.read.schema(ROWS).parquet(f"{base}/rows/*").join(failed, "digest", "left_semi"), "exact-failed-rows")
                texts = materialise(fetch(docs, rows.select("file", "at", F.lit(False).alias("hot")), digest, files), "exact-failed-texts")
            again = by_text(texts, rows).join(marked.select("file", "at"), ["file", "at"], "left_semi")
            marked = materialise(marked.join(failed, "digest", "left_anti").select(*_OUT).unionByName(again.select(*_OUT)), "exact-regrouped", keep=True)
        return marked.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(True)).alias("kept"), "digest", "file", "at")


_OUT = ("doc_id", "digest", "file", "at", "keep_id", "group_size")


def fetch(docs: DataFrame, places: DataFrame, digest, files: str | None) -> DataFrame:
    """(file, at, digest, hot, text) of the rows at places (file, at, hot): of docs, and of earlier runs' files."""
    spark = docs.sparkSession

    def of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        rows = rows.join(small(wanted), (rows[FILE] == wanted["file"]) & (rows[AT] == wanted["at"]))
        return rows.select(wanted["file"], wanted["at"], digest(normalised(rows["text"])).alias("digest"), wanted["hot"], normalised(rows["text"]).alias("text"))

    places = materialise(places, "exact-places")
    own = of(docs.select("text", FILE, AT), places)
    if files is None:
        return own
    places = materialise(places.join(docs.select(F.col(FILE).alias("file")).distinct(), "file", "left_anti"), "exact-earlier")
    paths = spark.read.schema("file long, path string").parquet(files).join(places.select("file").distinct(), "file", "left_semi").select("path").distinct()
    paths = materialise(paths, "exact-files")
    if paths.count() > MOST_FILES:
        paths = paths.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct()
    named = [r.path for r in paths.collect()]
    return own.unionByName(of(located(spark.read.schema("text string").parquet(*named), "exact-earlier-docs"), places)) if named else own


def differing(texts: DataFrame) -> DataFrame:
    """Digests whose texts aren't all the same, by their full bytes.

    A text moves once for each task that holds it. Those of hot digests (of over a thousandth of all rows, so under a
    thousand) are first brought together by groups of tasks, so that none meets a text from every task.
    """
    n = partitions(texts.sparkSession)
    some = texts.where("hot").groupBy("digest", "text", F.pmod(F.spark_partition_id(), F.lit(n)).alias("salt")).agg(F.count(F.lit(1)).alias("n"))
    each = texts.where("not hot").select("digest", "text").unionByName(some.select("digest", "text")).distinct()
    return each.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")


def by_text(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The groups of rows (doc_id, digest, file, at) whose digest the check has failed, by their full texts."""
    rows = rows.join(texts.select("file", "at", "text"), ["file", "at"])
    whole = rows.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(whole, ["digest", "text"])


def keep_first(docs: DataFrame, state: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows go by their place, so only the keys of those that go move."""
    columns, docs = docs.columns, _at_hand(docs, state)
    gone = materialise(groups(docs, state=state).where("not kept").select("file", "at"), "exact-gone")
    return docs.join(small(gone), (docs[FILE] == gone["file"]) & (docs[AT] == gone["at"]), "left_anti").select(*(docs[c] for c in columns))


def op7_exact_dedup(spark: SparkSession, sf_dir: str, state: str | None = None) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"), state=state)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept,
       sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
