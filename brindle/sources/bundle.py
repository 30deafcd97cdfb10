"""Readers of a knowledge bundle (a tree of markdown files), its index, log and dashboard, ledger and token file.

A bundle at scale is written once as a table with write_concepts(); the readers below are lazy scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T

EVENT_SCHEMA = (
    "event_id string, timestamp string, type string, source string, session_id string, goal_id string, summary string, payload_ref string, "
    "confidence double, epistemic_status string, evidence_refs array<string>, related_memory_nodes array<string>"
)


def read_files(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path, text): files under root whose folders don't start with a dot; path is relative, text has line feeds only."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    mark = root.rstrip("/").split("://")[-1]
    full = F.url_decode(F.col("_metadata.file_path"))
    path = F.substring(full, F.instr(full, mark) + len(mark) + 1, F.length(full))
    out = raw.select(path.alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    return out.where(~F.col("path").rlike(r"(^|/)\.[^/]*/"))


def concepts(files: DataFrame) -> DataFrame:
    """One row per concept: files with a header, reserved names at any depth left out."""
    name = F.element_at(F.split("path", "/"), -1)
    fm = T.frontmatter(F.col("text"))
    rows = files.where(~name.isin(*C.RESERVED_FILES)).withColumn("fm", fm).where(F.size("fm") > 0)
    return rows.select(
        F.col("path").alias("concept_id"),
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "").alias("stem"),
        F.coalesce(F.col("fm")["type"], F.lit("")).alias("type"),
        F.coalesce(F.col("fm")["description"], F.lit("")).alias("description"),
        F.when(F.col("fm")["tags"].isNotNull(), T.inline_list(F.col("fm")["tags"])).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.col("fm")["timestamp"], F.lit("")).alias("timestamp"),
        "fm",
        T.body(F.col("text")).alias("body"),
        "text",
    )


def write_concepts(df: DataFrame, path: str) -> None:
    """Concepts as Parquet, partitioned by type so that a type filter prunes files."""
    df.write.mode("overwrite").partitionBy("type").parquet(path)


def hook_concepts(files: DataFrame) -> DataFrame:
    """Concepts that a prompt may be given: the short header parser, skipped types and the root dashboard left out."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where(~name.isin("index.md", "INDEX.md", "log.md") & (F.col("path") != "Dashboard.md")).withColumn("fm", T.short_frontmatter(F.col("text")))
    kind = F.coalesce(F.col("fm")["type"], F.lit(""))
    hay = F.concat_ws(" ", F.coalesce(F.col("fm")["description"], F.lit("")), F.coalesce(F.col("fm")["tags"], F.lit("")), F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    return rows.where(F.col("fm").isNotNull() & (F.size("fm") > 0) & ~kind.isin(*C.SKIPPED_TYPES)).select("path", hay.alias("hay"), "text")


def sections(df: DataFrame, key: str = "concept_id", text: str = "body") -> DataFrame:
    """(key, pos, heading, slug, node, text) of each level-two section."""
    out = df.select(key, F.posexplode(T.sections(F.col(text))).alias("pos", "text"))
    heading = F.trim(F.regexp_extract("text", r"^##\s*(.*)", 1))
    return out.select(key, "pos", heading.alias("heading"), T.slug(heading).alias("slug"), F.concat(F.col(key), F.lit("#"), T.slug(heading)).alias("node"), "text")


def numbered_lines(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(keep..., line_no, line) of a text column."""
    return df.select(*keep, F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))


def lesson_index(lines: DataFrame, *keep: str) -> DataFrame:
    """(keep..., line_no, target, alias, kw_line, keywords) of lines '[[target|alias]] - kw1, kw2'; other lines go."""
    pattern = C.INDEX_LINE
    link, kw = F.regexp_extract("line", pattern, 1), F.regexp_extract("line", pattern, 2)
    parts = F.split(link, r"\|", 2)
    keys = F.filter(F.transform(F.split(kw, "[,/]"), lambda k: F.lower(F.trim(k))), lambda k: k != "")
    return lines.where(F.col("line").rlike(pattern)).select(*keep, "line_no", F.trim(F.element_at(parts, 1)).alias("target"), F.when(F.size(parts) > 1, F.element_at(parts, 2)).alias("alias"), F.trim(kw).alias("kw_line"), keys.alias("keywords"))


def dashboard_fields(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., field, value) of lines '- **Field:** value'."""
    p = C.FIELD_LINE
    return lines.where(F.col("line").rlike(p)).select(*by, F.regexp_extract("line", p, 1).alias("field"), F.regexp_extract("line", p, 2).alias("value"))


def log_entries(lines: DataFrame, *by: str) -> DataFrame:
    """(by..., line_no, date, label, text) of '* **Label**: text' lines under their '## date' heading, for each log (by)."""
    date = F.last(F.when(F.col("line").startswith("## "), F.trim(F.substr("line", F.lit(4)))), ignorenulls=True).over(W.partitionBy(*by).orderBy("line_no"))
    p = C.LOG_LINE
    return lines.withColumn("date", date).where(F.col("line").rlike(p)).select(*by, "line_no", "date", F.regexp_extract("line", p, 1).alias("label"), F.regexp_extract("line", p, 2).alias("text"))


def directory_entries(files: DataFrame, folder: str = "") -> DataFrame:
    """(fn, line, lower, upper) of a folder's entries: its listing line, and the text of its own index.md and INDEX.md."""
    prefix = f"{folder.strip('/')}/" if folder else ""
    inside = files.where(F.col("path").startswith(prefix)).select(F.substr("path", F.lit(len(prefix) + 1)).alias("rest"), "text")
    parts = F.split("rest", "/")
    fn = F.element_at(parts, 1)
    about = F.coalesce(T.frontmatter(F.col("text"))["description"], F.lit(""))
    line = F.when(F.size(parts) > 1, F.concat(F.lit("* "), fn, F.lit("/ - directory"))).otherwise(F.concat(F.lit("* ["), fn, F.lit("]("), fn, F.lit(") - "), about))
    return inside.groupBy(fn.alias("fn")).agg(F.min(line).alias("line"), F.max(F.when(F.col("rest") == "index.md", F.col("text"))).alias("lower"), F.max(F.when(F.col("rest") == "INDEX.md", F.col("text"))).alias("upper"))


def directory_index(files: DataFrame, folder: str = "") -> DataFrame:
    """(path, index): the folder's own index.md, else INDEX.md, else a listing of its entries by name.

    The listing is one text, so its lines meet in one row; directory_entries() has them as rows.
    """
    entries = directory_entries(files, folder)
    shown = F.collect_list(F.when(~F.col("fn").startswith("."), F.struct("fn", "line")))
    whole = entries.agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"), F.array_sort(shown).alias("l"))
    made = F.concat_ws("\n", F.lit(f"# Index: {folder or '/'}"), F.transform("l", lambda x: x["line"]))
    return whole.select(F.lit(folder or "/").alias("path"), F.coalesce("lower", "upper", made).alias("index"))


def point_read(files: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """(text) of one file, its first characters where there is a limit, '' where it isn't there: dashboard, index and log reads."""
    text = F.coalesce(F.max("text"), F.lit(""))
    return files.where(F.col("path") == path).agg((text if limit is None else F.left(text, F.lit(limit))).alias("text"))


def get_concepts(requests: DataFrame, known: DataFrame, wanted: str = "wanted") -> DataFrame:
    """requests with the concept they want by path or id: concept_id, type, description, tags, body, and error where
    there is none. Missing keys are '' and an empty list."""
    rows = requests.withColumn("concept_id", T.concept_id(F.col(wanted)))
    found = known.select("concept_id", "type", "description", "tags", "body")
    out = rows.join(found, "concept_id", "left")
    return out.select(*requests.columns, "concept_id", "type", "description", "tags", "body", F.when(F.col("body").isNull(), "no such concept").alias("error"))


def get_concept(known: DataFrame, path: str) -> dict:
    """One concept by path or id; LookupError without one."""
    spark = known.sparkSession
    row = get_concepts(spark.range(1).select(F.lit(path).alias("wanted")), known).first()
    if row.error:
        raise LookupError(f"{row.error}: {path}")
    return {"id": row.concept_id, "type": row.type, "description": row.description, "tags": list(row.tags), "body": row.body}


def write_files(files: DataFrame, root: str) -> None:
    """Write each (path, text) as a file below root, on the executors; a file that is there is replaced, none is deleted.

    files must not be read from what it replaces: writes.commit() sees to that.
    """

    def save(rows) -> None:
        import pyarrow.fs as pafs

        fs, base = None, None
        for row in rows:
            if fs is None:
                fs, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
            at = f"{base.rstrip('/')}/{row.path}"
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(at) as f:
                f.write(row.text.encode())

    files.select("path", "text").foreachPartition(save)


def read_events(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """Ledger rows; a malformed line fails the read."""
    rows = spark.read.schema(EVENT_SCHEMA).json(path, mode="FAILFAST")
    return rows if session_id is None else rows.where(F.col("session_id") == session_id)


def tokens(lines: DataFrame) -> DataFrame:
    """(token, username, role) of 'token:username:role' lines; bad lines go; of one token the last line counts."""
    parts = F.transform(F.split(F.trim("line"), ":"), lambda x: F.trim(x))
    ok = lines.where(~F.trim("line").startswith("#")).select("line_no", parts.alias("p")).where(F.size("p") == 3)
    rows = ok.select("line_no", F.col("p")[0].alias("token"), F.col("p")[1].alias("username"), F.lower(F.col("p")[2]).alias("role"))
    rows = rows.where((F.col("token") != "") & (F.col("username") != "") & F.col("role").isin("user", "admin"))
    last = rows.groupBy("token").agg(F.max_by(F.struct("username", "role"), "line_no").alias("r"))
    return last.select("token", "r.username", "r.role")


def authenticate(requests: DataFrame, known: DataFrame, bearer: str = "bearer", domain: str = "example.com") -> DataFrame:
    """requests with name, email, is_admin, and error where the credential is missing, empty or unknown."""
    value = F.trim(F.regexp_replace(F.trim(bearer), r"(?i)^bearer ", ""))
    out = requests.withColumn("token", value).join(known, "token", "left")
    error = F.when(F.col(bearer).isNull() | (F.col(bearer) == ""), "missing bearer credential").when(F.col("token") == "", "empty bearer credential").when(F.col("username").isNull(), "unknown token")
    return out.select(*requests.columns, F.col("username").alias("name"), F.concat(F.col("username"), F.lit(f"@{domain}")).alias("email"), (F.col("role") == "admin").alias("is_admin"), error.alias("error"))
