"""Policy rules: candidates, promotion, replay, simulations, contradictions, metrics, link graph.

Where a policy gives no formula, the one chosen is in the docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C

def lesson_candidate(change: Column, general: Column, evidence: Column) -> Column:
    return (change >= 0.60) & (general >= 0.50) & (evidence >= 0.60)


def durable_lesson(strong_constraint: Column, independent_tasks: Column, verified_sources: Column) -> Column:
    return strong_constraint | (independent_tasks >= 2) | (verified_sources >= 2)


def skill_promotion(successes: Column, confidence: Column, contradictions: Column, reuse: Column) -> Column:
    return (successes >= 2) & (confidence >= 0.75) & (contradictions == 0) & (reuse >= 0.50)


def replay(error: Column, reward: Column, harm: Column, correction: Column, conflict: Column) -> Column:
    return (error >= 0.25) | (reward >= 0.60) | (harm >= 0.30) | correction | conflict


def hot_paths(paths: DataFrame, by: list[str], success: Column, cost: Column, high_cost: float) -> DataFrame:
    """Paths used 5 times or more with a success rate of 0.80 or more and a mean retrieval cost of high_cost or more."""
    out = paths.groupBy(*by).agg(F.count(F.lit(1)).alias("use_count"), F.round(F.avg(success.cast("double")), 6).alias("success_rate"), F.round(F.avg(cost), 6).alias("mean_cost"))
    return out.where((F.col("use_count") >= 5) & (F.col("success_rate") >= 0.80) & (F.col("mean_cost") >= high_cost))


def contradictions(edges: DataFrame) -> DataFrame:
    """Active edges (source, target, relation, scope array, edge_id) that an active edge of the opposite relation
    (R and does_not_R) contradicts in a shared scope: (edge_id, status testing).

    Each scope of a pair of nodes is asked once whether both signs stand in it; no two edges are compared.
    """
    base = F.regexp_replace("relation", "^does_not_", "")
    rows = edges.where("status = 'active'").withColumn("base", base).withColumn("negative", F.col("relation").startswith("does_not_"))
    place = ["source", "target", "base", "part"]
    parts = rows.select("edge_id", "source", "target", "base", "negative", F.explode(F.array_distinct("scope")).alias("part"))
    both = parts.groupBy(*place).agg(F.bool_or("negative").alias("no"), F.bool_and("negative").alias("only")).where("no and not only").select(*place)
    return parts.join(both, place, "left_semi").select("edge_id").distinct().withColumn("status", F.lit("testing"))


def cognitive_efficiency(quality: Column, cost: Column) -> Column:
    """Quality of what was done over what it cost; null where it cost nothing."""
    return F.try_divide(quality, cost)


def expected_value(branches: DataFrame, option: str = "option_id") -> DataFrame:
    """(option, expected): sum of probability * (goal_progress - risk - cost) over an option's branches."""
    v = F.col("probability") * (F.col("goal_progress") - F.col("risk") - F.col("cost"))
    return branches.groupBy(option).agg(F.round(F.sum(v), 6).alias("expected"))


def shortlist(options: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """At most 8 raw options per group, of these 3 shortlisted, of these 2 simulated deeply; adds rank, stage and whether
    the gap between best and second stops the simulation (0.20 or more)."""
    w = W.partitionBy(*by).orderBy(F.desc(score), order)
    ranked = options.withColumn("rank", F.row_number().over(w)).where("rank <= 8")
    stage = F.when(F.col("rank") <= 2, "deep").when(F.col("rank") <= 3, "shortlisted").otherwise("raw")
    gap = F.max(F.when(F.col("rank") == 1, F.col(score))).over(W.partitionBy(*by)) - F.max(F.when(F.col("rank") == 2, F.col(score))).over(W.partitionBy(*by))
    return ranked.withColumn("stage", stage).withColumn("stops", F.coalesce(gap >= 0.20, F.lit(True)))


def efficiency(rows: DataFrame) -> DataFrame:
    """One row of ratios over retrieval records (retrieved, used, repeated, full_read booleans; branches, sessions,
    lessons counts; decisions, reversals): each ratio is marked records over retrieved records, branches is a mean per
    record, compression is sessions over lessons, reversal is reversals over decisions; nothing below is null."""
    def share(c):
        return F.round(F.try_divide(F.count_if(F.col(c) & F.col("retrieved")), F.count_if("retrieved")), 6)

    return rows.agg(
        F.round(F.try_divide(F.count_if(F.col("retrieved") & ~F.col("used")), F.count_if("retrieved")), 6).alias("unused_retrieval_ratio"),
        share("repeated").alias("duplicate_context_ratio"),
        share("full_read").alias("full_file_read_ratio"),
        F.round(F.avg("branches"), 6).alias("average_simulation_branches"),
        F.round(F.try_divide(F.sum("sessions"), F.sum("lessons")), 6).alias("session_to_lesson_ratio"),
        F.round(F.try_divide(F.sum("reversals"), F.sum("decisions")), 6).alias("decision_reversal_rate"),
    )


def link_graph(links: DataFrame) -> DataFrame:
    """(a, b) undirected links, each once, without loops."""
    return links.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def broken_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose target doesn't exist: tolerated, listed."""
    return links.join(nodes.select(F.col("node").alias("target")), "target", "left_anti")


def stale(index: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): in the index but not on disk, or on disk but not in the index."""
    a, b = index.select("path").distinct().withColumn("i", F.lit(1)), files.select("path").distinct().withColumn("f", F.lit(1))
    out = a.join(b, "path", "full_outer").withColumn("problem", F.when(F.col("f").isNull(), "missing file").when(F.col("i").isNull(), "not indexed"))
    return out.where("problem is not null").select("path", "problem")


def assembly(nodes: DataFrame, by: list[str], order: str = "ref", most: int = C.ASSEMBLY_NODES) -> DataFrame:
    """(by..., nodes): the most activated nodes (ref, activation, role) of each goal, best first, at most 8.

    Ranked before they are collected, so a group never holds more than these.
    """
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("activation"), order))
    top = nodes.withColumn("rank", rank).where(F.col("rank") <= most)
    listed = F.array_sort(F.collect_list(F.struct("rank", F.struct(order, "activation", "role").alias("node"))))
    return top.groupBy(*by).agg(F.transform(listed, lambda x: x["node"]).alias("nodes"))


def workspace(items: DataFrame, by: list[str], kind: str, priority: str, order: str) -> DataFrame:
    """Items that working memory holds: of each kind as many as its limit, the most important; kinds without a limit go."""
    limit = F.lit(0)
    for k, n in C.WORKSPACE_LIMITS.items():
        limit = F.when(F.col(kind) == k, n).otherwise(limit)
    rank = F.row_number().over(W.partitionBy(*by, kind).orderBy(F.desc(priority), order))
    return items.withColumn("rank", rank).where(F.col("rank") <= limit)


def narrative(records: DataFrame, kind: str, subject: str, session: str) -> DataFrame:
    """(kind, subject, sessions, recurs): in how many sessions each project, decision, mistake, strategy or commitment
    stands, and whether it stands in two or more: rebuilt from session records alone."""
    out = records.groupBy(kind, subject).agg(F.countDistinct(session).alias("sessions"))
    return out.withColumn("recurs", F.col("sessions") >= 2)
