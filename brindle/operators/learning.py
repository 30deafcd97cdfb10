"""Edge weights, decisions, consolidation and ledger state.

The weight update w -> min(hi, max(lo, w + d)) doesn't commute, but runs of it compose to one step of the same form, so
an edge's history is folded in pieces: ranges of edge and order, of about a partition each, then an edge composes its
pieces. No task holds the history of a hot edge. In doubles this agrees with the one-by-one fold to rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scoring as S

STEP = "struct<lo:double,hi:double,d:double>"


def _step(lo: Column, hi: Column, d: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), d.alias("d"))


def _then(f: Column, g: Column) -> Column:
    """f, then g, as one step."""
    def into(x):
        return F.greatest(g["lo"], F.least(g["hi"], x + g["d"]))

    return _step(into(f["lo"]), into(f["hi"]), f["d"] + g["d"])


def _fold(steps: Column) -> Column:
    none = _step(F.lit(float("-inf")), F.lit(float("inf")), F.lit(0.0))
    return F.aggregate(steps, none, lambda a, x: _then(a, x["s"]))


def weight_steps(updates: DataFrame, key: list[str], order: list[str], piece: Column | None = None) -> DataFrame:
    """(key, s, up, down): all updates of each edge (key, reward, eligibility, confidence, independence, order...) as one
    step, with its successes and failures. Updates under the eligibility bound do nothing.

    Pieces are ranges of (key, order), of about equal size however hot an edge is, unless piece (which rises with order)
    names them: each is folded in order, then an edge's pieces are composed in turn.
    """
    dw = S.weight_change(F.col("reward"), F.col("eligibility"), F.col("confidence"), F.col("independence"))
    rows = updates.withColumn("dw", dw).where("dw is not null").select(*key, *order, "reward", "dw", *([] if piece is None else [piece.alias("piece")]))
    if piece is None:
        n = int(updates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, *key, *order).withColumn("piece", F.spark_partition_id())
    one = F.struct(*order, _step(F.lit(0.0), F.lit(C.WEIGHT_MAX), F.col("dw")).alias("s"))
    by_piece = rows.groupBy(*key, "piece").agg(_fold(F.array_sort(F.collect_list(one))).alias("s"), F.count_if(F.col("reward") >= 0).alias("up"), F.count_if(F.col("reward") < 0).alias("down"))
    return compose(by_piece, key, "piece")


def compose(steps: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, s, up, down): the steps of each edge in order as one."""
    return steps.groupBy(*key).agg(_fold(F.array_sort(F.collect_list(F.struct(order, "s")))).alias("s"), F.sum("up").alias("up"), F.sum("down").alias("down"))


def apply_steps(edges: DataFrame, steps: DataFrame, key: list[str]) -> DataFrame:
    """edges (key, weight, success_count, failure_count) after their steps; steps of edges that don't exist do nothing."""
    out = edges.join(steps, key, "left")
    moved = F.greatest(F.col("s.lo"), F.least(F.col("s.hi"), F.col("weight") + F.col("s.d")))
    return out.withColumns({"weight": F.when(F.col("s").isNull(), F.col("weight")).otherwise(moved), "success_count": F.col("success_count") + F.coalesce("up", F.lit(0)), "failure_count": F.col("failure_count") + F.coalesce("down", F.lit(0))}).drop("s", "up", "down")


def edge_weights(updates: DataFrame, edges: DataFrame, key: list[str], order: list[str], piece: Column | None = None) -> DataFrame:
    """edges after all updates, in order."""
    return apply_steps(edges, weight_steps(updates, key, order, piece), key)


def insert_or_ignore(have: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """have, and those rows of new whose key isn't there; of new rows with one key the first weight in order."""
    first = new.groupBy(*key).agg(F.min_by(F.struct(*[c for c in new.columns if c not in key]), "ord").alias("r")).select(*key, "r.*")
    return have.unionByName(first.join(have.select(*key), key, "left_anti").select(*have.columns))


def consolidate(edges: DataFrame, last_use: DataFrame | None = None, key: tuple[str, ...] = ("source", "target", "relation")) -> DataFrame:
    """edges with the status that consolidation gives active ones; last_use: (key, unused_days), missing is 0."""
    rows = edges.join(last_use, list(key), "left") if last_use is not None else edges.withColumn("unused_days", F.lit(0))
    status = S.edge_status(F.col("weight"), F.col("success_count"), F.col("failure_count"), F.col("contradiction_conf"), F.col("unused_days"), F.col("unique_info"))
    return rows.withColumn("status", F.when(F.col("status") == "active", status).otherwise(F.col("status"))).drop("unused_days")


def status_counts(before: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """One row: how many edges are suppressed and archived."""
    return before.agg(F.count_if(F.col("status") == "suppressed").alias("suppressed"), F.count_if(F.col("status") == "archived").alias("archived"))


def open_decision(decisions: DataFrame) -> DataFrame:
    add = {"outcome": F.lit(None).cast("string"), "prediction_error": F.lit(None).cast("double")}
    return decisions.withColumns({k: v for k, v in add.items() if k not in decisions.columns}).withColumn("status", F.lit("open"))


def close_decisions(decisions: DataFrame, outcomes: DataFrame, key: str = "decision_id") -> DataFrame:
    """Decisions that have an outcome, with prediction_error = observed - predicted (3 places), status and flag."""
    out = decisions.drop("outcome", "prediction_error", "status").join(outcomes, key)
    error = F.round(F.col("observed") - F.col("predicted"), 3)
    return out.withColumns({"prediction_error": error, "status": F.lit("verified"), "flagged": F.abs(error) >= C.ERROR_FLAG})


def resume(events: DataFrame, by: list[str], order: Column, kind: str) -> DataFrame:
    """(by..., event_count, last_event) of each session."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("event_count"), F.max_by(kind, order).alias("last_event"))


def resume_state(events: DataFrame, memory: DataFrame, by: list[str], order: Column, kind: str) -> DataFrame:
    """resume() with focus and next_action of the working memory (rows of key, value), which is not kept by session."""
    def held(k):
        return F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)

    one = memory.agg(held("focus"), held("next_action")).withColumn("one", F.lit(1))
    return resume(events, by, order, kind).withColumn("one", F.lit(1)).join(F.broadcast(one), "one").drop("one")  # a single row


def merge_deltas(deltas: DataFrame, by: list[str], order: Column, value: str) -> DataFrame:
    """Working memory after all deltas: of each key the latest value; keys never go."""
    return deltas.groupBy(*by).agg(F.max_by(value, order).alias(value))


def transitions(rows: DataFrame, by: list[str], order: list[str], status: str, allowed: tuple = C.GOAL_STEPS) -> DataFrame:
    """rows with previous status, and whether the step to the present one is allowed (a first status always is)."""
    before = F.lag(status).over(W.partitionBy(*by).orderBy(*order))
    ok = F.col("before").isNull() | (F.col("before") == F.col(status))
    for a, b in allowed:
        ok = ok | ((F.col("before") == a) & (F.col(status) == b))
    return rows.withColumn("before", before).withColumn("allowed", ok)
