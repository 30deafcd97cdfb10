"""Gated writes as pure plans: each function splits candidates into accepted writes and rejections; writes.apply() applies
them to the files.

Order of the gates for every write: author, target, secrets in every field, header. Nothing is deleted. A single driver
applies a batch, which takes the place of a writer lock; author and message go to the audit columns. Within a batch,
writes count in the order of their ord column, where they have one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import gates as G
from ..functions import text as T


def _author_error() -> Column:
    ok = (F.coalesce(F.col("author_name"), F.lit("")) != "") & (F.coalesce(F.col("author_email"), F.lit("")) != "")
    return F.when(~ok, "an authenticated author is required")


def split(rows: DataFrame, *errors: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with their first error)."""
    marked = rows.withColumn("error", F.coalesce(*errors, F.lit(None).cast("string")))
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def _ordered(rows: DataFrame) -> DataFrame:
    return rows if "ord" in rows.columns else rows.withColumn("ord", F.lit(0))


def _spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all tasks: the gates cost far more than reading narrow rows, which one task may read."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _secret(*fields: Column) -> Column:
    return G.secret_reason(F.concat_ws("\n", *fields))


def new_lesson(candidates: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """candidates (area, slug, content, keywords, author_*): a section for an existing area file and an index line."""
    kind = T.lesson_kind(F.col("content"))
    body = T.stripped(F.regexp_replace("content", C.LESSON_KIND_LINE, ""))
    path = F.concat(F.lit("Lessons/"), F.col("area"), F.lit("/"), kind, F.lit(".md"))
    rows = _spread(_ordered(candidates)).withColumns({"path": path, "section_body": body}).join(files.select("path", F.col("text").alias("existing")), "path", "left")
    ok, bad = split(
        rows,
        _author_error(),
        F.when(F.col("existing").isNull(), "lesson file does not exist"),
        _secret(F.col("area"), F.col("slug"), F.col("section_body"), F.array_join("keywords", "\n")),
        G.violation(F.col("existing")),
    )
    line = F.concat(F.lit("- [["), F.regexp_extract("path", r"^Lessons/(.*)\.md$", 1), F.lit("]] — "), F.array_join("keywords", ", "))
    section = F.concat(F.lit("\n## "), F.col("slug"), F.lit("\n"), F.col("section_body"), F.lit("\n"))
    log = T.filled(C.LOG_LESSON, F.col("path"), F.col("slug"))
    return ok.select("path", section.alias("append"), F.concat(F.lit("## "), F.col("area")).alias("index_heading"), line.alias("index_line"), log.alias("log_line"), "author_name", "author_email", "ord"), bad


def new_skill(candidates: DataFrame, files: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """candidates (name, content, author_*): a new skill document; a header is made where there is no type. Of several
    with one name the first (by ord, name, content) is taken.

    The gates run where the candidates are read; only the content is shuffled, once for both results, and documents are
    made again of what is accepted."""
    path = F.concat(F.lit("Skills/"), T.slug(F.col("name")), F.lit(".md"))
    head = T.filled(C.SKILL_HEADER, F.replace("name", F.lit('"'), F.lit("'")), F.lit(today), F.col("name"))
    has_type = F.coalesce(F.length(T.frontmatter(F.col("content"))["type"]) > 0, F.lit(False))
    doc = F.when(has_type, F.col("content")).otherwise(F.concat(head, F.regexp_replace("content", r"(?U)^\s+", "")))
    rows = _ordered(candidates).withColumns({"path": path, "document": doc, "author_error": _author_error()})
    gate = F.when(F.col("author_error").isNull(), F.coalesce(_secret(F.col("name"), F.col("document")), G.violation(F.col("document"))))
    rows = rows.withColumn("gate", gate).drop("document").join(files.select("path", F.lit(True).alias("there")), "path", "left")
    rows = rows.withColumn("own_error", F.coalesce("author_error", F.when(F.col("there"), "skill already exists"), "gate")).drop("author_error", "gate")
    again = F.row_number().over(W.partitionBy("path", F.col("own_error").isNull()).orderBy("ord", "name", "content")) > 1
    ok, bad = split(rows.withColumn("again", again), F.col("own_error"), F.when(F.col("again"), "skill already exists"))
    ok = ok.withColumn("document", doc)
    return ok.select("path", T.with_line_end(F.col("document")).alias("document"), T.filled(C.LOG_SKILL, F.col("path")).alias("log_line"), "author_name", "author_email", "ord"), bad


def bump_timestamp(text: Column, today: str) -> Column:
    """The header's first timestamp line with today's date; a line of the body is never touched."""
    return F.when(T.frontmatter(text)["timestamp"].isNotNull(), F.regexp_replace(text, r"(?m)\A((?:(?!^---[ \t]*$)[^\n]*\n|\A---[^\n]*\n)*?timestamp:[ \t]*)[^\n]*", f"$1{today}")).otherwise(text)


def update_concept(patches: DataFrame, files: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """patches (concept_id, patch, author_*): each concept once, with all its accepted patches appended in order (ord, then
    patch) and a new timestamp. log_line has a line for each patch, the last on top; the author is the last one's."""
    rows = _spread(_ordered(patches)).withColumn("path", T.concept_id(F.col("concept_id"))).join(files.select("path", F.col("text").alias("existing")), "path", "left")
    ok, bad = split(rows, _author_error(), F.when(G.protected(F.col("concept_id")), "protected target"), F.when(F.col("existing").isNull(), "no such concept"), _secret(F.col("patch")), G.violation(bump_timestamp(F.col("existing"), today)))
    one = F.struct("ord", "patch", "author_name", "author_email")
    whole = ok.groupBy("path").agg(F.first("existing").alias("existing"), F.array_sort(F.collect_list(one)).alias("all"))
    added = F.array_join(F.transform("all", lambda x: F.concat(F.lit("\n\n"), T.stripped(x["patch"]))), "")
    doc = bump_timestamp(F.concat(T.without_last_lines(F.col("existing")), added, F.lit("\n")), today)
    line = T.filled(C.LOG_CONCEPT, F.col("path"))
    last = F.element_at("all", -1)
    return whole.select("path", doc.alias("document"), F.array_join(F.transform("all", lambda x: line), "\n").alias("log_line"), last["author_name"].alias("author_name"), last["author_email"].alias("author_email"), last["ord"].alias("ord")), bad


def session_stem(handoff: Column, today: str) -> Column:
    """date[-topic]: the header's date, else the first in the text, else today; topic from the first heading."""
    day = r"(\d{4}-\d{2}-\d{2})"
    date = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(T.frontmatter(handoff)["timestamp"], F.lit("")), day, 1), F.lit("")), F.nullif(F.regexp_extract(handoff, day, 1), F.lit("")), F.lit(today))
    title = F.regexp_extract(handoff, r"(?m)^#\s+(.+)$", 1)
    topic = F.when(title == "", "").otherwise(T.slug(F.regexp_replace(title, r"^\s*\d{4}-\d{2}-\d{2}\s*[—:-]*\s*", "")))
    return F.when((topic != "") & (topic != date), F.concat(date, F.lit("-"), topic)).otherwise(date)


def free_numbers(rows: DataFrame, taken: DataFrame, by: str, order: str) -> DataFrame:
    """rows with n: in order, the numbers from 1 that taken (by, n) leaves free in their group.

    The k-th free number is k and the taken ones before it: those that have fewer than k free numbers below them. One
    window over rows and taken numbers counts these.
    """
    k = F.row_number().over(W.partitionBy(by).orderBy(order))
    below = F.col("n") - F.row_number().over(W.partitionBy(by).orderBy("n"))
    gone = taken.select(by, "n").distinct().select(by, below.cast("long").alias("k"), F.lit(1).alias("is_taken"), F.lit(None).alias("row"))
    asked = rows.select(F.struct(*rows.columns).alias("row"), F.col(by), k.cast("long").alias("k")).select(by, "k", F.lit(0).alias("is_taken"), "row")
    before = F.sum("is_taken").over(W.partitionBy(by).orderBy("k", "is_taken").rowsBetween(W.unboundedPreceding, W.currentRow))
    both = asked.unionByName(gone.withColumn("row", F.col("row").cast(asked.schema["row"].dataType)))
    return both.withColumn("n", F.col("k") + before).where("is_taken = 0").select("row.*", "n")


def log_session(handoffs: DataFrame, files: DataFrame, today: str, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """handoffs (handoff, author_*, order): session documents with a free name; name-2, name-3 ... follow a taken one."""
    ok, bad = split(handoffs, _author_error(), G.violation(F.col("handoff")), _secret(F.col("handoff")))
    rows = ok.withColumn("stem", session_stem(F.col("handoff"), today))
    # names of a stem that are taken: the stem itself is 1, stem-n is n
    name = F.regexp_extract("path", r"^Sessions/(.*)\.md$", 1)
    names = files.select(name.alias("name")).where("name <> ''")
    both = names.select(F.col("name").alias("stem"), F.lit(1).alias("n")).unionByName(names.select(F.regexp_extract("name", r"^(.*)-\d+$", 1).alias("stem"), F.expr(r"try_cast(regexp_extract(name, '-([1-9]\\d*)$', 1) AS int)").alias("n")).where("stem <> '' and n > 1"))
    rows = free_numbers(rows, both.join(rows.select("stem").distinct(), "stem", "left_semi"), "stem", order)
    rows = rows.withColumn("name", F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat(F.col("stem"), F.lit("-"), F.col("n").cast("string"))))
    path = F.concat(F.lit("Sessions/"), F.col("name"), F.lit(".md"))
    line = F.concat(F.lit("* ["), F.col("name"), F.lit("]("), F.col("name"), F.lit(".md) - "), F.coalesce(T.frontmatter(F.col("handoff"))["description"], F.lit("")))
    return rows.select(path.alias("path"), T.with_line_end(F.col("handoff")).alias("document"), line.alias("index_line"), T.filled(C.NOTE_SESSION, F.col("name")).alias("note"), T.filled(C.LOG_SESSION, path).alias("log_line"), "author_name", "author_email", F.col(order).alias("ord")), bad


def proposal_id(text: Column, rationale: Column) -> Column:
    return F.concat(F.lit("proposal-"), F.substring(F.sha1(F.concat(text, F.lit("|"), rationale).cast("binary")), 1, 8))


def new_rule(rules: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """rules (rule, rationale, author_*): pending proposals, one per id however often it is sent."""
    ok, bad = split(rules, _author_error(), _secret(F.col("rule"), F.col("rationale")))
    pid = proposal_id(F.col("rule"), F.col("rationale"))
    doc = T.filled(C.PROPOSAL_HEADER, pid, F.lit(today), F.col("author_name"), T.stripped(F.col("rule")), T.stripped(F.col("rationale")))
    rows = ok.select(pid.alias("proposal_id"), F.concat(F.lit("mcp_proposals/"), pid, F.lit(".md")).alias("path"), doc.alias("document"), "author_name", "author_email")
    return rows.groupBy("proposal_id", "path").agg(F.min_by(F.struct("document", "author_name", "author_email"), "document").alias("r")).select("proposal_id", "path", "r.*"), bad


def approve(requests: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (proposal_id, is_admin) against proposals (path, text): the rule to append and the proposal approved.
    Each proposal is approved once: of several valid requests the first (by ord), the others find it pending no more."""
    rows = _ordered(requests).withColumn("path", F.concat(F.lit("mcp_proposals/"), F.regexp_replace("proposal_id", r"\.md$", ""), F.lit(".md"))).join(proposals.select("path", "text"), "path", "left")
    status = T.frontmatter(F.col("text"))["status"]
    error = F.coalesce(
        F.when(~F.coalesce("is_admin", F.lit(False)), "admin privilege required"),
        F.when(F.col("text").isNull(), "no such proposal"),
        F.when(F.coalesce(status, F.lit("")) != "pending", "proposal is not pending"),
        _secret(F.col("text")),
    )
    rows = rows.withColumn("own_error", error)
    turn = F.row_number().over(W.partitionBy("path", F.col("own_error").isNull()).orderBy("ord", "proposal_id"))
    ok, bad = split(rows.withColumn("turn", turn), F.col("own_error"), F.when(F.col("turn") > 1, "proposal is not pending"))
    body = T.body(F.col("text"))
    pid = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    add = T.filled(C.RULE_ADDED, pid, T.section(body, "Rule"), T.section(body, "Rationale"))
    done = F.regexp_replace("text", r"(?m)^status:\s*pending\s*$", "status: approved")
    who = F.coalesce(F.nullif(T.frontmatter(F.col("text"))["author"], F.lit("")), F.lit("admin"))
    return ok.select("path", add.alias("rules_append"), done.alias("document"), T.filled(C.LOG_APPROVED, pid).alias("log_line"), who.alias("author_name"), F.concat(who, F.lit("@example.com")).alias("author_email"), "ord"), bad


def prepend_log(log: Column, line: Column) -> Column:
    """A log with the line under its topmost level-two heading, or at the end without one."""
    pos = F.regexp_instr(log, F.lit(r"(?m)^## "))
    heading = F.regexp_extract(F.substring(log, pos, F.length(log)), r"^[^\n]*", 0)
    cut = pos - 1 + F.length(heading)
    end = F.regexp_replace(log, r"\n+\z", "")
    inserted = F.concat(F.substring(log, F.lit(1), cut), F.lit("\n"), line, F.substring(end, cut + 1, F.length(end)), F.lit("\n"))
    return F.when(pos > 0, inserted).otherwise(F.concat(end, F.when(end == "", "").otherwise("\n"), line, F.lit("\n")))


def replace_field(dashboard: Column, name: str, value: Column) -> Column:
    """The dashboard with the first '- **name:** ...' line's value replaced."""
    p = rf"(?s)\A((?:.*?\n)?-[ \t]*\*\*\Q{name}\E:\*\*)[^\n]*"
    safe = F.regexp_replace(value, r"([\\$])", r"\\$1")
    return F.regexp_replace(dashboard, F.lit(p), F.concat(F.lit("$1 "), safe))


def insert_after_heading(text: Column, heading: Column, line: Column) -> Column:
    """Text with the line after the first line that is the heading; a new section at the end without it."""
    ls = T.lines(text)
    at = F.array_position(F.transform(ls, T.stripped), heading).cast("int")
    with_it = F.concat(F.slice(ls, F.lit(1), at), F.array(line), F.slice(ls, at + 1, F.greatest(F.size(ls) - at, F.lit(0))))
    return F.concat(F.array_join(F.when(at > 0, with_it).otherwise(F.concat(ls, F.array(F.lit(""), heading, line))), "\n"), F.lit("\n"))


def _inserted(text: str, headings: list[str | None], lines: list[str | None]) -> str:
    """Text after each line in turn was put after the first line that is its heading, or at the end in a new section.

    The text is split once and joined once. A line that is one of the headings is a list that takes what is put after it,
    and has a place; places compare as the lines stand: of what is put after a line, the latest comes first. As the text
    would be split again for each line, line ends within all but the last count as line ends.
    """
    wanted, first = set(headings), {}

    def placed(added: list[str], place: tuple[int, ...]) -> list:
        out = []
        for i, line in enumerate(added):
            name = line.strip()
            if name in wanted:
                line = [line]
                if name not in first or (*place, i) < first[name][0]:
                    first[name] = (*place, i), line
            out.append(line)
        return out

    end = text.splitlines()
    before = len(end)
    end = placed(end, ())
    for n, (heading, line) in enumerate(zip(headings, lines, strict=True), 1):
        at = first.get(heading)
        added = [x for x in ([line] if at else ["", heading, line]) if x is not None]
        if n < len(headings):
            added = [y for x in added for y in f"{x}\n".splitlines()]
            added = placed(added, (*at[0], -n) if at else (before + n,))
        if at:
            at[1].append(added)
        else:
            end += added
    out, left = [], [iter(end)]
    while left:
        for x in left[-1]:
            if isinstance(x, str):
                out.append(x)
            else:
                out.append(x[0])
                left.append(y for added in reversed(x[1:]) for y in added)
                break
        else:
            left.pop()
    return "\n".join(out) + "\n"


def insert_after_headings(text: Column, headings: Column, lines: Column) -> Column:
    """Text with each of the lines, in their order, after the first line that is its heading; a new section at the end
    without it. One pass over text and lines."""

    @F.arrow_udf("string")
    def inserted(texts: pa.Array, headings: pa.Array, lines: pa.Array) -> pa.Array:
        rows = zip(texts, headings, lines, strict=True)
        return pa.array([_inserted(t.as_py(), h.as_py(), x.as_py()) if t.is_valid and x.is_valid else None for t, h, x in rows], pa.string())

    return inserted(text, headings, lines)
