"""Search, lesson and concept matching, graded retrieval, quotas. Ties go to the smaller id.

Scores are computed on narrow rows; texts are joined after the limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scoring as S
from ..functions import text as T


def search(concepts: DataFrame, query: str, kind: str | None = None, limit: int = 10, description: str = "description") -> DataFrame:
    """(concept_id, description, score), best first: three points for each occurrence of a query word in description,
    tags and stem, one for each in the body. An empty query, or a concept without occurrences, gives nothing."""
    if limit < 0:
        raise ValueError("limit is not negative")
    found = T.literal_query_words(query)
    rows = concepts.where(F.col("type") == kind) if kind else concepts
    if not found:
        return rows.select("concept_id", F.col(description).alias("description"), F.lit(0).cast("long").alias("score")).limit(0)
    head = F.lower(F.concat_ws(" ", F.col(description), F.array_join("tags", " "), F.col("stem")))
    text = F.lower("body")
    score = reduce(lambda a, b: a + b, (T.occurrences(head, w) * C.FRONTMATTER_WEIGHT + T.occurrences(text, w) for w in found))
    scored = rows.select("concept_id", F.col(description).alias("description"), score.alias("score")).where("score > 0")
    return scored.orderBy(F.desc("score"), "concept_id").limit(limit)


def find_skill(concepts: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """search() among skills."""
    return search(concepts, query, kind="Skill", limit=limit)


#: Concepts of any kind.
find_concept = search


def find_lesson(index: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    """(target, concept_id, kw_line, score): lines with a keyword that contains the wanted one or is contained in it."""
    kw = (keyword or "").lower().strip()
    hits = F.size(F.filter("keywords", lambda k: F.contains(k, F.lit(kw)) | F.contains(F.lit(kw), k)))
    rows = index.select("line_no", "target", T.concept_id(F.concat(F.lit("Lessons/"), F.col("target"))).alias("concept_id"), "kw_line", hits.cast("long").alias("score"))
    return rows.where((F.col("score") > 0) & F.lit(bool(kw))).orderBy(F.desc("score"), "line_no").limit(limit).drop("line_no")


def matched_lessons(prompts: DataFrame, index: DataFrame, existing: DataFrame, most: int = C.MAX_LESSONS) -> DataFrame:
    """(prompt_id, target, score, rank): index lines by how many of their keywords stand in the prompt as words.

    Lines whose lesson doesn't exist go; of lines to one lesson the best ranked stays. One equi join takes all keywords
    to the prompts: those of word characters only meet the prompt's tokens; of any other keyword, its first token must be
    a token of the prompt, and the keyword as a whole is then looked for with a pattern. A keyword without a letter or
    digit stands as a word only where it is all that lies between two words, so it meets these gaps. The keywords are made
    and read once; lessons that don't exist go when the hits are counted.
    """
    low = prompts.select("prompt_id", F.lower("prompt").alias("low"))

    def met(kind: int, pattern: str, text: Column) -> DataFrame:
        found = F.array_distinct(F.regexp_extract_all("low", F.lit(pattern), F.lit(0)))
        return low.select("prompt_id", text.alias("low"), F.lit(kind).alias("kind"), F.explode(found).alias("by"))

    none = F.lit(None).cast("string")
    asked = met(0, "[a-z0-9_]+", none).unionByName(met(1, r"(?U)\w+", F.col("low"))).unionByName(met(2, r"(?U)(?<=\w)\W+(?=\w)", none))
    first = F.regexp_extract("key", r"(?U)\w+", 0)
    keys = index.select("line_no", "target", F.explode("keywords").alias("key"))
    keys = keys.withColumn("first", F.when(F.col("key").rlike("^[a-z0-9_]+$"), None).otherwise(first))
    kind = F.when(F.col("first").isNull(), 0).when(F.col("first") != "", 1).otherwise(2)
    keys = keys.select("line_no", "target", "key", kind.alias("kind"), F.when(kind == 1, F.col("first")).otherwise(F.col("key")).alias("by"))
    stands = F.expr(r"kind <> 1 or (contains(low, key) and rlike(low, concat('(?U)\\b\\Q', key, '\\E\\b')))")
    both = keys.join(asked, ["kind", "by"]).where(stands)
    hits = both.groupBy("prompt_id", "line_no", "target").agg(F.count(F.lit(1)).alias("score")).join(existing.select("target"), "target", "left_semi")
    best = W.partitionBy("prompt_id", "target").orderBy(F.desc("score"), "line_no")
    once = hits.withColumn("n", F.row_number().over(best)).where("n = 1")
    rank = F.row_number().over(W.partitionBy("prompt_id").orderBy(F.desc("score"), "line_no"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("prompt_id", "target", "score", "rank")


def matched_concepts(prompts: DataFrame, concepts: DataFrame, exclude: DataFrame | None = None, most: int = C.MAX_CONCEPTS, least: int = C.MIN_OVERLAP) -> DataFrame:
    """(prompt_id, path, score, rank): concepts by the number of distinct prompt words among their own words (hay).

    An equi join on words, counted by pair; exclude holds (prompt_id, path) pairs that are already chosen.
    """
    p = prompts.select("prompt_id", F.explode(T.prompt_words(F.col("prompt"))).alias("w"))
    c = concepts.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("hay"), F.lit(T.TOKEN), F.lit(0)))).alias("w"))
    scored = c.join(p, "w").groupBy("prompt_id", "path").agg(F.count(F.lit(1)).alias("score")).where(F.col("score") >= least)
    if exclude is not None:
        scored = scored.join(exclude.select("prompt_id", "path"), ["prompt_id", "path"], "left_anti")
    rank = F.row_number().over(W.partitionBy("prompt_id").orderBy(F.desc("score"), "path"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("prompt_id", "path", "score", "rank")


def staged_lesson(prompt: Column, text: Column) -> Column:
    """The lesson's description and its sections that share a word with the prompt, cut at 4000 characters."""
    fm = T.short_frontmatter(text)
    own = T.prompt_words(prompt)
    hit = F.filter(T.sections(text), lambda s: F.arrays_overlap(F.regexp_extract_all(F.lower(s), F.lit(T.TOKEN), F.lit(0)), own))
    about = F.coalesce(F.trim(fm["description"]), F.lit(""))
    parts = F.filter(F.concat(F.array(about), hit), lambda x: x != "")
    return F.left(F.trim(F.array_join(parts, "\n\n")), F.lit(C.LESSON_CHARS))


def progressive_retrieve(candidates: DataFrame, by: list[str], order: str, adjust: float = 0.0, max_full: int = 1, activation: str = "activation") -> DataFrame:
    """candidates with level and rank: at most max_full full reads per group, the rest step down; ignored ones go.

    A level never falls as activation rises, so the full reads are the first ranks; order breaks ties.
    """
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(activation), order))
    level = S.retrieval_level(F.col(activation), adjust)
    out = candidates.withColumn("rank", rank).withColumn("level", F.when((level == C.TOP_LEVEL) & (F.col("rank") > max_full), C.LEVELS[-1][1]).otherwise(level))
    return out.where("level <> 'ignore'")


def within_quota(rows: DataFrame, by: list[str], kind: str, quota: dict[str, int], score: str, order: str) -> DataFrame:
    """Rows whose rank in their group and kind is within the kind's quota; a kind without a quota has none left."""
    rank = F.row_number().over(W.partitionBy(*by, kind).orderBy(F.desc(score), order))
    most = F.lit(0)
    for k, n in quota.items():
        most = F.when(F.col(kind) == k, n).otherwise(most)
    return rows.withColumn("quota_rank", rank).where(F.col("quota_rank") <= most)


def within_levels(rows: DataFrame, by: list[str], score: str, order: str, level: str = "level", quota: dict[tuple[str, ...], int] = C.LEVEL_QUOTA) -> DataFrame:
    """Rows within their group's quota of reads by level; levels that share a quota count together."""
    share, most = F.lit(None).cast("string"), F.lit(0)
    for names, n in quota.items():
        share = F.when(F.col(level).isin(*names), names[0]).otherwise(share)
        most = F.when(F.col(level).isin(*names), n).otherwise(most)
    rank = F.row_number().over(W.partitionBy(*by, share).orderBy(F.desc(score), order))
    return rows.withColumn("quota_rank", rank).where(F.col("quota_rank") <= most)


def last_lines(lines: DataFrame, n: int, by: list[str], newest: bool = False) -> DataFrame:
    """The last n non-empty lines of each group in file order, or with newest the first n: the log is written on top."""
    if n < 0:
        raise ValueError("n is not negative")
    order = F.col("line_no") if newest else F.desc("line_no")
    rank = F.row_number().over(W.partitionBy(*by).orderBy(order))
    return lines.where(F.trim("line") != "").withColumn("n", rank).where((F.col("n") <= n) | F.lit(n == 0)).drop("n")
