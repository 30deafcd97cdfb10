"""Helpers shared by the corpus operators: shared storage, materialised steps, bounded labelled samples."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Temporary column names start with this, so they cannot clash with a caller's columns.
MINE = "__brindle_"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: list[str] = []
#: Folders of written steps: of each open scratch() the ones to delete at its end, and at the bottom those that stay.
_written: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a temporary
    folder that goes with the process; any other session is an error, for its executors would each write to their own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="brindle-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        at = "file://" + _local[0]
    return at.rstrip("/")


def fresh_path(spark: SparkSession, label: str, mine: bool = False) -> str:
    """A folder that isn't there yet; mine: it goes with the scratch() around."""
    path = f"{shared_dir(spark)}/brindle/{label}-{uuid.uuid4().hex}"
    if mine:
        _written[-1].append(path)
    return path


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Steps written within are deleted at its end, but for those written with keep: these belong to what is around it."""
    _written.append([])
    try:
        yield
    finally:
        delete(spark, _written.pop())


def release(spark: SparkSession) -> None:
    """Delete what results of this process still read: call it when they are written."""
    delete(spark, _written[0])


def materialise(df: DataFrame, label: str, keep: bool = False, at: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder (or to at, which then stays) and read it back.

    That cuts lineage: losing an executor later recomputes no step before this one.
    """
    spark = df.sparkSession
    path = at or fresh_path(spark, label)
    if not at:
        _written[-2 if keep and len(_written) > 1 else -1].append(path)
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # shuffle files of a step go when its result is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if held is None else spark.conf.set(_CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path)


#: Where a row lies: its file (a hash of the path) and its number there.
FILE, AT, PATH = f"{MINE}file", f"{MINE}at", f"{MINE}path"
#: Keys that are broadcast at most: some 150 bytes each.
MOST_KEYS = 500_000


def located(docs: DataFrame, label: str, at: str | None = None) -> DataFrame:
    """docs with FILE, AT and PATH, which tell rows apart whatever their columns hold.

    A Parquet table gives them as it is read. Any other DataFrame is written first (to at, if that is given).
    """
    if FILE in docs.columns:
        return docs
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            meta = docs.metadataColumn("_metadata")
            return docs.select("*", F.xxhash64(meta["file_path"]).alias(FILE), meta["row_index"].alias(AT), meta["file_path"].alias(PATH))
        except AnalysisException:
            pass
    return located(materialise(docs, label, keep=True, at=at), label)


def small(keys: DataFrame) -> DataFrame:
    """A written table of keys, broadcast behind a check of its size; beyond that Spark shuffles both sides."""
    return F.broadcast(keys) if keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0: rows never used for learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most most_per_class training rows of each class, chosen by a hash of doc_id.

    The bound keeps the fit on the driver bounded at every size; scoring still covers every row. Null labels, null
    texts, held-out rows and ids with labels of both classes are left out. Choosing ids first keeps the texts out of the sort.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
    known = usable.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("doc_id", "y")
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1])
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_document(docs: DataFrame, columns: list[str], fn: Callable, schema: str) -> DataFrame:
    """mapInArrow over the named columns only; fn gets a dict of Python lists per batch and returns one of them."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, step = batch.num_rows, 512
            for i in range(0, n, step):
                out = fn(batch.slice(i, min(step, n - i)).to_pydict())
                if out and len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return docs.select(*columns).mapInArrow(run, schema)
