"""Applying a batch of accepted writes to the files of a bundle, as one plan: documents, appended sections, index lines,
the log and the dashboard.

Each file is folded once, from all writes that name it, in their order; a file that no write names stays as it is, and
none goes. What meets in one row is what one file gets: the log's lines of a batch are the widest. The result is the
new (path, text, changed) of every file; commit() writes those that changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..sources.bundle import write_files
from ..sources.storage import shared_path
from .proposals import insert_after_headings, prepend_log, replace_field

LOG, DASHBOARD, LESSONS, SESSIONS, RULES = "log.md", "Dashboard.md", "Lessons/INDEX.md", "Sessions/index.md", "rules/working-rules.md"


def _by_path(rows: DataFrame, name: str, *fields: str) -> DataFrame:
    """(path, name): the rows of each path as structs, in order."""
    return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias(name))


def apply(files: DataFrame, today: str, documents: DataFrame | None = None, lessons: DataFrame | None = None, sessions: DataFrame | None = None, approvals: DataFrame | None = None) -> DataFrame:
    """files (path, text) after the accepted writes that the functions of proposals.py give: documents (new or updated
    skills, concepts, proposals), lessons, sessions and approvals. (path, text, changed) of every file."""
    given = [x for x in (documents, sessions, approvals) if x is not None]
    out = files.select("path", "text", F.col("text").alias("before"))
    if given:
        made = reduce(DataFrame.unionByName, (x.select("path", "document") for x in given))
        out = out.join(made.groupBy("path").agg(F.max("document").alias("document")), "path", "full_outer")
        out = out.select("path", F.coalesce("document", "text").alias("text"), "before")
    if lessons is not None:
        out = _with_sections(out, _by_path(lessons, "sections", "append"))
        lines = lessons.select(F.lit(LESSONS).alias("path"), "ord", "index_heading", "index_line")
        out = out.join(_by_path(lines, "lines", "index_heading", "index_line"), "path", "left")
        index = F.when(F.col("lines").isNotNull(), F.col("text"))
        placed = insert_after_headings(index, F.transform("lines", lambda x: x["index_heading"]), F.transform("lines", lambda x: x["index_line"]))
        out = out.withColumn("text", F.when(F.col("lines").isNotNull(), placed).otherwise(F.col("text"))).drop("lines")
    if sessions is not None:
        out = _with_lines(out, _by_path(sessions.select(F.lit(SESSIONS).alias("path"), "ord", "index_line"), "lines", "index_line"))
        note = sessions.agg(F.max_by("note", F.struct("ord", "path")).alias("note")).where("note is not null").withColumn("path", F.lit(DASHBOARD))
        updated, status = C.DASHBOARD_FIELDS
        shown = replace_field(replace_field(F.col("text"), updated, F.lit(today)), status, F.col("note"))
        out = out.join(note, "path", "left").withColumn("text", F.when(F.col("note").isNotNull(), shown).otherwise(F.col("text"))).drop("note")
    if approvals is not None:
        out = _with_sections(out, _by_path(approvals.select(F.lit(RULES).alias("path"), "ord", F.col("rules_append").alias("append")), "sections", "append"))
    logged = [x for x in (documents, lessons, sessions, approvals) if x is not None and "log_line" in x.columns]
    if logged:
        lines = reduce(DataFrame.unionByName, (x.select(F.lit(LOG).alias("path"), F.struct(F.lit(i).alias("kind"), x["ord"].cast("long").alias("ord")).alias("ord"), "log_line") for i, x in enumerate(logged)))
        out = out.join(_by_path(lines, "lines", "log_line"), "path", "full_outer").withColumn("text", F.coalesce("text", F.lit("")))  # a log that isn't there is begun
        said = F.transform("lines", lambda x: x["log_line"])
        on_top = F.coalesce(F.col("text").rlike(r"(?m)^## "), F.lit(False))
        joined = F.array_join(F.when(on_top, F.reverse(said)).otherwise(said), "\n")
        out = out.withColumn("text", F.when(F.col("lines").isNotNull(), prepend_log(F.col("text"), joined)).otherwise(F.col("text"))).drop("lines")
    return out.select("path", "text", (~F.col("text").eqNullSafe(F.col("before"))).alias("changed"))


def commit(after: DataFrame, root: str) -> int:
    """Write the files of apply() that changed below root; their number.

    They are written to the shared folder first: a task that runs again must not read a file that it has changed.
    """
    spark, path = after.sparkSession, shared_path(after.sparkSession, "writes")
    after.where("changed").select("path", "text").write.parquet(path)
    changed = spark.read.schema("path string, text string").parquet(path)
    write_files(changed, root)
    return changed.count()


def _with_sections(files: DataFrame, added: DataFrame) -> DataFrame:
    """Sections (each from a line feed to a line feed) after the text of their files, a blank line before each."""
    parts = F.array_join(F.transform("sections", lambda x: F.concat(F.lit("\n"), T.without_last_lines(x["append"]))), "")
    text = F.concat(T.without_last_lines(F.col("text")), parts, F.lit("\n"))
    return files.join(added, "path", "left").withColumn("text", F.when(F.col("sections").isNotNull(), text).otherwise(F.col("text"))).drop("sections")


def _with_lines(files: DataFrame, added: DataFrame) -> DataFrame:
    """Lines after the text of their files."""
    said = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("\n"), x["index_line"])), "")
    text = F.concat(T.without_last_lines(F.col("text")), said, F.lit("\n"))
    return files.join(added, "path", "left").withColumn("text", F.when(F.col("lines").isNotNull(), text).otherwise(F.col("text"))).drop("lines")
