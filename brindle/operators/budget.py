"""Context assembly under a character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C

MODES = {"": ("static", "retrieval"), "full": ("static", "retrieval"), "static": ("static",), "retrieval": ("retrieval",)}


def within_budget(parts: DataFrame, by: list[str], order: str, text: str, cap: int) -> DataFrame:
    """Parts that fit, in order, the crossing one cut: adds piece. Empty parts go; separators don't count."""
    before = F.coalesce(F.sum(F.length(text)).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    full = parts.where(F.length(text) > 0).withColumn("before", before).where(F.col("before") < cap)
    return full.withColumn("piece", F.left(F.col(text), (F.lit(cap) - F.col("before")).cast("int"))).drop("before")


def assemble(parts: DataFrame, by: list[str], order: str, text: str, cap: int = C.CONTEXT_CHARS) -> DataFrame:
    """(by..., context): the parts that fit, joined by blank lines. A group holds at most cap parts."""
    fit = within_budget(parts, by, order, text, cap)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda x: x["piece"]), "\n\n")
    return fit.groupBy(*by).agg(joined.alias("context"))


def prompt_parts(prompts: DataFrame, dashboard: str, lessons: DataFrame, concepts: DataFrame, mode: str = "", title: str = "Dashboard", rules: str = "") -> DataFrame:
    """(prompt_id, ordinal, part) of the chosen mode: rules if given, dashboard, then lessons and concepts by rank.

    lessons: (prompt_id, target, rank, chunk); concepts: (prompt_id, path, rank, text).
    """
    kinds = MODES[mode.strip().lower()]
    out = [prompts.select("prompt_id", F.lit(-1).alias("ordinal"), F.lit(rules).alias("part"))] if rules else []
    if "static" in kinds:
        out.append(prompts.select("prompt_id", F.lit(0).alias("ordinal"), F.lit(f"--- {title} ---\n{dashboard}").alias("part")))
    if "retrieval" in kinds:
        lesson = F.concat(F.lit("--- Lesson: "), F.col("target"), F.lit(" ---\n"), F.col("chunk"))
        out.append(lessons.where(F.length("chunk") > 0).select("prompt_id", F.col("rank").alias("ordinal"), lesson.alias("part")))
        text = F.left(F.col("text"), F.lit(C.CONCEPT_CHARS))
        concept = F.concat(F.lit("--- Concept: "), F.col("path"), F.lit(" ---\n"), text)
        out.append(concepts.where(F.length("text") > 0).select("prompt_id", (F.col("rank") + 1000).alias("ordinal"), concept.alias("part")))
    first, *more = out
    for df in more:
        first = first.unionByName(df)
    return first
