"""Queries over events, embeddings and labels: scoring, learning, consolidation, metrics.

The driver's tables stand in for the ledger: a user is a session and an edge's source, an event type its target, and
signals are deterministic functions of event_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scoring as S
from ..operators import learning as L
from ..operators import policy as P
from ..operators import ranking as R
from ..sources import bundle
from ..sources.storage import shared_path
from ..streaming import ledger

START = 0.40


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _signals(names) -> dict[str, int]:
    """A multiplier for each signal name."""
    return {n: 2 * i + 3 for i, n in enumerate(names)}


def _with_signals(df: DataFrame, names, id_col: str = "event_id") -> DataFrame:
    return df.select("*", *(((F.col(id_col) * k) % 101 / F.lit(100.0)).alias(n) for n, k in _signals(names).items()))


def _signals_sql(names, id_col: str = "event_id") -> str:
    return ", ".join(f"(({id_col} * {k}) % 101) / 100.0::DOUBLE AS {n}" for n, k in _signals(names).items())


def _linear_sql(weights: dict[str, float], factor: dict[str, float] | None = None) -> str:
    def term(n, w):
        x = f"({n} * {factor[n]}::DOUBLE)" if factor and n in factor else n
        return f"{w}::DOUBLE * {x}"

    return "0.0::DOUBLE + " + " + ".join(term(n, w) for n, w in weights.items())


_LEVEL_SQL = "CASE WHEN {a} < 0.35 THEN 'ignore' WHEN {a} < 0.5 THEN 'index_only' WHEN {a} < 0.65 THEN 'frontmatter' WHEN {a} < 0.78 THEN 'matching_section' WHEN {a} < 0.88 THEN 'adjacent_sections' ELSE 'full_concept' END"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as candidates: cosine to the vector of ones is the semantic similarity, other signals follow vec_id.

    Summed in index order in doubles, then rounded, so that every engine gives the same.
    """
    e = _read(spark, sf_dir, "embeddings")
    def dot(f):
        return F.aggregate("embedding", F.lit(0.0), lambda a, x: a + f(x.cast("double")))

    cos = F.round((1 + dot(lambda x: x) / (F.sqrt(dot(lambda x: x * x)) * 8.0)) / 2, 9)
    rows = _with_signals(e.select("vec_id", "label", cos.alias("cosine")), C.ACTIVATION, "vec_id")
    rows = rows.withColumn("semantic_similarity", F.col("cosine"))
    for n in ("contradiction_inhibition", "project_mismatch", "deprecated_penalty", "token_cost_penalty", "refractory_penalty"):
        rows = rows.withColumn(n, F.when(F.col("vec_id") % 7 == 0, F.col(n)).otherwise(0.0))
    return rows.select("vec_id", "label", F.round(S.activation(), 6).alias("activation"))


def _candidates_sql() -> str:
    names = ", ".join(
        "cosine AS semantic_similarity" if n == "semantic_similarity" else f"CASE WHEN vec_id % 7 = 0 THEN ((vec_id * {k}) % 101) / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS {n}" if C.ACTIVATION[n] < 0 else f"((vec_id * {k}) % 101) / 100.0::DOUBLE AS {n}"
        for n, k in _signals(C.ACTIVATION).items()
    )
    return f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
w AS (SELECT vec_id, label, round((1 + list_reduce(list_prepend(0.0::DOUBLE, e), lambda a, x: a + x)
    / (sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(e, lambda x: x * x)), lambda a, x: a + x)) * 8.0::DOUBLE)) / 2, 9) AS cosine FROM v),
x AS (SELECT vec_id, label, {names} FROM w),
c AS (SELECT vec_id, label, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_linear_sql(C.ACTIVATION)})), 6) AS activation FROM x)"""


def activation_levels(spark, sf_dir):
    a = F.col("activation")
    return _candidates(spark, sf_dir).select("vec_id", "activation", S.retrieval_level(a).alias("level"), S.retrieval_level(F.round(a - 0.10, 6)).alias("level_under_pressure"))


ACTIVATION_LEVELS = f"WITH {_candidates_sql()} SELECT vec_id, activation, {_LEVEL_SQL.format(a='activation')} AS level, {_LEVEL_SQL.format(a='round(activation - 0.1::DOUBLE, 6)')} AS level_under_pressure FROM c"


def progressive_retrieve(spark, sf_dir):
    return R.progressive_retrieve(_candidates(spark, sf_dir), ["label"], "vec_id").select("label", "vec_id", F.round("activation", 3).alias("activation"), "level", "rank")


PROGRESSIVE = f"""WITH {_candidates_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY activation DESC, vec_id) AS rank, {_LEVEL_SQL.format(a='activation')} AS l FROM c)
SELECT label, vec_id, round(activation, 3) AS activation, CASE WHEN l = 'full_concept' AND rank > 1 THEN 'adjacent_sections' ELSE l END AS level, rank FROM r WHERE l <> 'ignore'"""


def retrieval_quotas(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("kind", F.element_at(F.array(*map(F.lit, C.TYPE_QUOTA)), (F.col("vec_id") % 5 + 1).cast("int")))
    return R.within_quota(rows, ["label"], "kind", C.TYPE_QUOTA, "activation", "vec_id").select("label", "kind", "vec_id", "activation", "quota_rank")


QUOTAS = f"""WITH {_candidates_sql()}, k AS (SELECT *, ['session', 'lesson', 'skill', 'knowledge', 'project'][vec_id % 5 + 1] AS kind FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY label, kind ORDER BY activation DESC, vec_id) AS quota_rank FROM k)
SELECT label, kind, vec_id, activation, quota_rank FROM r WHERE quota_rank <= CASE kind WHEN 'session' THEN 2 WHEN 'lesson' THEN 4 WHEN 'skill' THEN 2 WHEN 'knowledge' THEN 3 ELSE 2 END"""


def salience_gate(spark, sf_dir):
    rows = _with_signals(_read(spark, sf_dir, "events").select("event_id"), C.SALIENCE).withColumn("salience", F.round(S.salience(), 6))
    s = F.col("salience")
    return rows.select("event_id", "salience", S.attention(s).alias("gate"), S.confidence_bucket(s).alias("bucket"))


SALIENCE_GATE = f"""WITH s AS (SELECT event_id, {_signals_sql(C.SALIENCE)} FROM events), t AS (SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_linear_sql(C.SALIENCE)})), 6) AS salience FROM s)
SELECT event_id, salience, CASE WHEN salience < 0.25 THEN 'log_only' WHEN salience >= 0.55 THEN 'workspace' ELSE 'watch' END AS gate,
CASE WHEN salience < 0.25 THEN 'weak speculation' WHEN salience < 0.5 THEN 'plausible, unverified' WHEN salience < 0.7 THEN 'moderate confidence' WHEN salience < 0.85 THEN 'strong evidence' WHEN salience < 0.95 THEN 'multiple confirmations' ELSE 'direct, repeated, reliable' END AS bucket FROM t"""


def goal_priority(spark, sf_dir):
    rows = _with_signals(_read(spark, sf_dir, "events").select("event_id"), C.GOAL)
    source = F.element_at(F.array(*map(F.lit, C.AUTHORITY)), (F.col("event_id") % 6 + 1).cast("int"))
    return rows.withColumn("source_authority", S.authority(source)).select("event_id", F.round(S.goal_priority(), 6).alias("priority"))


GOAL_PRIORITY = f"""WITH s AS (SELECT event_id, {_signals_sql(C.GOAL)} FROM events), t AS (SELECT * REPLACE ([1.0, 0.95, 0.85, 0.65, 0.4, 0.2][event_id % 6 + 1]::DOUBLE AS source_authority) FROM s)
SELECT event_id, round({_linear_sql(C.GOAL)}, 6) AS priority FROM t"""


def _options(spark, sf_dir):
    rows = _with_signals(_read(spark, sf_dir, "events").select("event_id", "user_id"), C.DECISION)
    return rows.withColumn("policy_violation", F.when(F.col("event_id") % 11 == 0, F.col("policy_violation")).otherwise(0.0))


_OPTIONS_SQL = f"s AS (SELECT event_id, user_id, {_signals_sql(C.DECISION)} FROM events), o AS (SELECT * REPLACE (CASE WHEN event_id % 11 = 0 THEN policy_violation ELSE 0.0::DOUBLE END AS policy_violation) FROM s)"


def decision_score(spark, sf_dir):
    out = _options(spark, sf_dir).select("event_id", F.round(S.decision_score(), 6).alias("score"))
    return out.withColumn("eliminated", F.col("score").isNull())


DECISION_SCORE = f"WITH {_OPTIONS_SQL} SELECT event_id, CASE WHEN policy_violation <= 0 THEN round({_linear_sql(C.DECISION)}, 6) END AS score, policy_violation > 0 AS eliminated FROM o"


def risk_mode_score(spark, sf_dir):
    return _options(spark, sf_dir).select("event_id", *(F.round(S.risk_mode_score(m), 6).alias(m) for m in C.RISK_MODES))


RISK_MODE_SCORE = f"WITH {_OPTIONS_SQL} SELECT event_id, " + ", ".join(f"CASE WHEN policy_violation <= 0 THEN round({_linear_sql(C.DECISION, {'risk': a, 'information_gain': b, 'reversibility': c})}, 6) END AS {m}" for m, (a, b, c) in C.RISK_MODES.items()) + " FROM o"


def option_shortlist(spark, sf_dir):
    rows = _options(spark, sf_dir).withColumn("score", F.round(S.decision_score(), 6)).where("score is not null")
    return P.shortlist(rows, ["user_id"], "score", "event_id").select("user_id", "event_id", "score", "rank", "stage", "stops")


OPTION_SHORTLIST = f"""WITH {_OPTIONS_SQL}, d AS (SELECT user_id, event_id, round({_linear_sql(C.DECISION)}, 6) AS score FROM o WHERE policy_violation <= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM d), k AS (SELECT * FROM r WHERE rank <= 8)
SELECT user_id, event_id, score, rank, CASE WHEN rank <= 2 THEN 'deep' WHEN rank <= 3 THEN 'shortlisted' ELSE 'raw' END AS stage,
coalesce(max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY user_id) - max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY user_id) >= 0.2::DOUBLE, true) AS stops FROM k"""


def expected_value(spark, sf_dir):
    """An event's three branches: probabilities 0.65, 0.25 and 0.10, values from its id."""
    e = _read(spark, sf_dir, "events").select("event_id")
    branches = [(0.65, 3), (0.25, 5), (0.10, 7)]
    b = F.array(*(F.struct(F.lit(p).alias("probability"), ((F.col("event_id") * k) % 101 / F.lit(100.0)).alias("goal_progress"), ((F.col("event_id") * k) % 31 / F.lit(100.0)).alias("risk"), ((F.col("event_id") * k) % 21 / F.lit(100.0)).alias("cost")) for p, k in branches))
    rows = e.select(F.col("event_id").alias("option_id"), F.inline(b))
    return P.expected_value(rows).withColumn("expected", F.col("expected") + 0.0)


EXPECTED_VALUE = "SELECT event_id AS option_id, round(" + " + ".join(f"{p}::DOUBLE * (((event_id * {k}) % 101) / 100.0::DOUBLE - ((event_id * {k}) % 31) / 100.0::DOUBLE - ((event_id * {k}) % 21) / 100.0::DOUBLE)" for p, k in [(0.65, 3), (0.25, 5), (0.10, 7)]) + ", 6) + 0.0::DOUBLE AS expected FROM events"


def reward_score(spark, sf_dir):
    rows = _with_signals(_read(spark, sf_dir, "events").select("event_id"), C.REWARD)
    return rows.select("event_id", F.round(S.reward(), 6).alias("reward"))


REWARD_SCORE = f"WITH s AS (SELECT event_id, {_signals_sql(C.REWARD)} FROM events) SELECT event_id, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_linear_sql(C.REWARD)})), 6) AS reward FROM s"


def state_actions(spark, sf_dir):
    rows = _with_signals(_read(spark, sf_dir, "events").select("event_id"), ["pressure", "uncertainty", "noise"])
    acts = S.state_actions(F.col("pressure"), F.col("uncertainty"), F.col("event_id") % 4)
    threshold = S.dynamic_threshold(S.pressure_adjust(F.col("pressure")), F.col("noise") * 0.1, F.lit(0.0), F.col("event_id") % 3 == 0)
    return rows.select("event_id", F.array_join(acts, ",").alias("actions"), F.round(threshold, 6).alias("threshold"))


STATE_ACTIONS = f"""WITH s AS (SELECT event_id, {_signals_sql(["pressure", "uncertainty", "noise"])} FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN pressure >= 0.7 THEN 'raise_thresholds' END, CASE WHEN pressure >= 0.7 THEN 'no_full_reads' END, CASE WHEN pressure >= 0.8 THEN 'handoff' END,
  CASE WHEN uncertainty >= 0.65 THEN 'verify' END, CASE WHEN event_id % 4 >= 2 THEN 'inhibit_strategy' END], lambda x: x IS NOT NULL), ',') AS actions,
round(0.5::DOUBLE + CASE WHEN pressure >= 0.7 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + noise * 0.1::DOUBLE + 0.0::DOUBLE - CASE WHEN event_id % 3 = 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 6) AS threshold FROM s"""


def ledger_resume(spark, sf_dir):
    return L.resume(_read(spark, sf_dir, "events"), ["user_id"], F.struct("ts", "event_id"), "event_type")


LEDGER_RESUME = "SELECT user_id, count(*) AS event_count, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY user_id"


def working_memory_latest(spark, sf_dir):
    return L.merge_deltas(_read(spark, sf_dir, "events"), ["user_id", "event_type"], F.struct("ts", "event_id"), "props")


WORKING_MEMORY = "SELECT user_id, event_type, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY user_id, event_type"


def prediction_error(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    opened = L.open_decision(e.select(F.col("event_id").alias("decision_id"), ((F.col("event_id") * 7) % 101 / F.lit(100.0)).alias("predicted")))
    seen = e.where(F.col("event_type") != "view").select(F.col("event_id").alias("decision_id"), ((F.col("event_id") * 11) % 101 / F.lit(100.0)).alias("observed"))
    return L.close_decisions(opened, seen).select("decision_id", "prediction_error", "flagged", "status")


PREDICTION_ERROR = """WITH d AS (SELECT event_id AS decision_id, round(((event_id * 11) % 101) / 100.0::DOUBLE - ((event_id * 7) % 101) / 100.0::DOUBLE, 3) AS prediction_error FROM events WHERE event_type <> 'view')
SELECT decision_id, prediction_error, abs(prediction_error) >= 0.25 AS flagged, 'verified' AS status FROM d"""


def _updates(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    reward = F.when(F.col("event_type") == "error", -0.8).when(F.col("event_type") == "purchase", 0.85).otherwise(((F.col("event_id") * 37) % 201 - 100) / F.lit(100.0))
    return e.select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("target"), F.lit("observed").alias("relation"), reward.alias("reward"), ((F.col("event_id") * 13) % 101 / F.lit(100.0)).alias("eligibility"), F.lit(0.9).alias("confidence"), ((F.col("event_id") % 5 + 1) / F.lit(5.0)).alias("independence"), "ts", "event_id")


def _edges(updates):
    return updates.select(*ledger.KEY).distinct().select(*ledger.KEY, F.lit(START).alias("weight"), F.lit(0).cast("long").alias("success_count"), F.lit(0).cast("long").alias("failure_count"))


def _weights(spark, sf_dir):
    u = _updates(spark, sf_dir)
    return L.edge_weights(u, _edges(u), ledger.KEY, ["ts", "event_id"])


def edge_weights(spark, sf_dir):
    return _weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


_WEIGHTS_SQL = """u AS (SELECT user_id::VARCHAR AS source, event_type AS target, 'observed' AS relation, ts, event_id,
  CASE event_type WHEN 'error' THEN -0.8::DOUBLE WHEN 'purchase' THEN 0.85::DOUBLE ELSE ((event_id * 37) % 201 - 100) / 100.0::DOUBLE END AS reward,
  ((event_id * 13) % 101) / 100.0::DOUBLE AS e, (event_id % 5 + 1) / 5.0::DOUBLE AS i FROM events),
d AS (SELECT *, CASE WHEN e >= 0.3::DOUBLE THEN CASE WHEN reward >= 0 THEN 0.1::DOUBLE ELSE 0.14::DOUBLE END * reward * e * 0.9::DOUBLE * i END AS dw FROM u),
g AS (SELECT source, target, relation, list(dw ORDER BY ts, event_id) FILTER (dw IS NOT NULL) AS l, count(*) FILTER (dw IS NOT NULL AND reward >= 0) AS success_count,
  count(*) FILTER (dw IS NOT NULL AND reward < 0) AS failure_count FROM d GROUP BY ALL),
w AS (SELECT source, target, relation, list_reduce(list_prepend(0.4::DOUBLE, coalesce(l, []::DOUBLE[])), lambda a, x: greatest(0.0::DOUBLE, least(0.95::DOUBLE, a + x))) AS weight, success_count, failure_count FROM g)"""
EDGE_WEIGHTS = f"WITH {_WEIGHTS_SQL} SELECT source, target, relation, round(weight, 6) AS weight, success_count, failure_count FROM w"


def _ledger_rows(updates):
    return updates.withColumns({"at": F.unix_micros(updates["ts"].cast("timestamp")), "seq": F.col("event_id")}).drop("ts", "event_id")


def ledger_stream_replay(spark, sf_dir):
    """Edge weights from the ledger's segments; a tenth of the edges isn't there, and stays away."""
    u = _updates(spark, sf_dir)
    path = shared_path(spark, "ledger")
    ledger.append_segment(_ledger_rows(u).repartitionByRange(8, "at", "seq"), path)
    return ledger.replay(spark, path, _edges(u).where("source % 10 <> 7")).withColumn("weight", F.round("weight", 6))


STREAM_REPLAY = f"WITH {_WEIGHTS_SQL} SELECT source, target, relation, round(weight, 6) AS weight, success_count, failure_count FROM w WHERE source::BIGINT % 10 <> 7"


def ledger_resumed_stream(spark, sf_dir):
    """The ledger appended to and replayed in two runs, the second from the first one's checkpoint."""
    u = _updates(spark, sf_dir)
    path, checkpoint, sink = (shared_path(spark, x) for x in ("ledger", "ledger-checkpoint", "ledger-steps"))
    rows, half = _ledger_rows(u), u.agg(F.unix_micros(F.expr("percentile_approx(cast(ts as timestamp), 0.5)"))).first()[0]
    ledger.append_segment(rows.where(F.col("at") < half).coalesce(2), path)
    ledger.replay(spark, path, _edges(u), checkpoint, sink, per_batch=2)
    ledger.append_segment(rows.where(F.col("at") >= half).coalesce(2), path)
    return ledger.replay(spark, path, _edges(u), checkpoint, sink).withColumn("weight", F.round("weight", 6))


def ledger_events(spark, sf_dir):
    """Events appended to a ledger in two segments and read again: of each session what its events say, clipped."""
    e = _read(spark, sf_dir, "events")
    path = shared_path(spark, "events")
    rows = e.select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("session_id"), F.repeat(F.concat(F.col("event_type"), F.lit("!")), (F.col("event_id") % 90).cast("int")).alias("summary"), (F.col("event_id") % 100 / F.lit(100.0)).alias("confidence"))
    ledger.append_segment(rows.where("event_id % 2 = 0"), path)
    ledger.append_segment(rows.where("event_id % 2 = 1"), path)
    read = bundle.read_events(spark, path)
    return read.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.sum(F.length("summary")).alias("chars"), F.max("summary").alias("last"), F.count("goal_id").alias("goals"), F.round(F.sum("confidence"), 6).alias("confidence"))


LEDGER_EVENTS = """SELECT user_id::VARCHAR AS session_id, count(*) AS events, sum(least(280, length(event_type || '!') * (event_id % 90)))::BIGINT AS chars, max(left(repeat(event_type || '!', (event_id % 90)::BIGINT), 280)) AS last, 0::BIGINT AS goals,
round(sum((event_id % 100) / 100.0::DOUBLE), 6) AS confidence FROM events GROUP BY user_id"""


def edge_insert_or_ignore(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    key = ["source", "target"]
    have = e.where("event_id % 3 = 0").select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("target")).distinct().withColumn("weight", F.lit(START))
    new = e.select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("target"), ((F.col("event_id") % 10) / F.lit(10.0)).alias("weight"), F.struct("ts", "event_id").alias("ord"))
    return L.insert_or_ignore(have, new, key)


INSERT_OR_IGNORE = """WITH h AS (SELECT DISTINCT user_id::VARCHAR AS source, event_type AS target, 0.4::DOUBLE AS weight FROM events WHERE event_id % 3 = 0),
n AS (SELECT user_id::VARCHAR AS source, event_type AS target, arg_min((event_id % 10) / 10.0::DOUBLE, (ts, event_id)) AS weight FROM events GROUP BY ALL)
SELECT * FROM h UNION ALL SELECT n.* FROM n ANTI JOIN h ON n.source = h.source AND n.target = h.target"""


def _consolidated(spark, sf_dir):
    rows = _weights(spark, sf_dir)
    h = F.length("target") + F.col("source").cast("long")
    rows = rows.select("*", ((h * 7) % 101 / F.lit(100.0)).alias("contradiction_conf"), (h % 2).cast("int").alias("unique_info"), F.when(h % 9 == 0, "testing").otherwise("active").alias("status"))
    unused = rows.select(*ledger.KEY, ((h * 13) % 200).cast("int").alias("unused_days")).where("unused_days > 20")
    return L.consolidate(rows, unused)


_CONSOLIDATED_SQL = f"""{_WEIGHTS_SQL}, x AS (SELECT *, length(target) + source::BIGINT AS h FROM w),
y AS (SELECT *, ((h * 7) % 101) / 100.0::DOUBLE AS cc, h % 2 AS uniq, CASE WHEN (h * 13) % 200 > 20 THEN (h * 13) % 200 ELSE 0 END AS days FROM x),
z AS (SELECT source, target, relation, CASE WHEN h % 9 = 0 THEN 'testing' WHEN (failure_count >= 2 AND success_count = 0) OR cc >= 0.8::DOUBLE THEN 'suppressed' WHEN weight < 0.1::DOUBLE AND days > 90 AND success_count = 0 AND uniq = 0 THEN 'archived' ELSE 'active' END AS status FROM y)"""


def consolidate_status(spark, sf_dir):
    return _consolidated(spark, sf_dir).select(*ledger.KEY, "status")


CONSOLIDATE_STATUS = f"WITH {_CONSOLIDATED_SQL} SELECT * FROM z"


def consolidate_counts(spark, sf_dir):
    return L.status_counts(_consolidated(spark, sf_dir))


CONSOLIDATE_COUNTS = f"WITH {_CONSOLIDATED_SQL} SELECT count(*) FILTER (status = 'suppressed') AS suppressed, count(*) FILTER (status = 'archived') AS archived FROM z"


def eligibility_credit(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    s = F.element_at(F.array(*map(F.lit, C.ELIGIBILITY.values())), (F.col("event_id") % 5 + 1).cast("int"))
    v = F.round(S.eligibility(s, F.col("event_id") % 12, (F.col("event_id") * 3) % 101 / F.lit(100.0)), 6)
    return e.select("event_id", v.alias("eligibility")).withColumn("credited", F.col("eligibility") >= C.MIN_ELIGIBILITY)


ELIGIBILITY_CREDIT = """WITH e AS (SELECT event_id, round([1.0, 0.8, 0.65, 0.15, 0.0][event_id % 5 + 1]::DOUBLE * exp(-(event_id % 12) / 5.0::DOUBLE) * (((event_id * 3) % 101) / 100.0::DOUBLE), 6) AS eligibility FROM events)
SELECT event_id, eligibility, eligibility >= 0.3 AS credited FROM e"""

_CAND = ["change", "generality", "evidence", "confidence", "reuse"]


def lesson_candidates(spark, sf_dir):
    rows = _with_signals(_read(spark, sf_dir, "events").select("event_id"), _CAND)
    out = rows.select("event_id", P.lesson_candidate(F.col("change"), F.col("generality"), F.col("evidence")).alias("candidate"), P.durable_lesson(F.col("event_id") % 13 == 0, F.col("event_id") % 3, F.col("event_id") % 4).alias("durable"))
    return out.where("candidate or durable")


LESSON_CANDIDATES = f"WITH s AS (SELECT event_id, {_signals_sql(_CAND)} FROM events), t AS (SELECT event_id, change >= 0.6 AND generality >= 0.5 AND evidence >= 0.6 AS candidate, event_id % 13 = 0 OR event_id % 3 >= 2 OR event_id % 4 >= 2 AS durable FROM s) SELECT * FROM t WHERE candidate OR durable"


def skill_promotion(spark, sf_dir):
    rows = _with_signals(_read(spark, sf_dir, "events").select("event_id"), _CAND)
    return rows.where(P.skill_promotion(F.col("event_id") % 4, F.col("confidence"), F.col("event_id") % 3, F.col("reuse"))).select("event_id", "confidence", "reuse")


SKILL_PROMOTION = f"WITH s AS (SELECT event_id, {_signals_sql(_CAND)} FROM events) SELECT event_id, confidence, reuse FROM s WHERE event_id % 4 >= 2 AND confidence >= 0.75 AND event_id % 3 = 0 AND reuse >= 0.5"

_REPLAY = ["error", "reward", "harm"]


def replay_selection(spark, sf_dir):
    rows = _with_signals(_read(spark, sf_dir, "events").select("event_id", "event_type"), _REPLAY)
    return rows.where(P.replay(F.col("error"), F.col("reward"), F.col("harm"), F.col("event_type") == "error", F.col("event_id") % 17 == 0)).select("event_id", "error", "reward", "harm")


REPLAY_SELECTION = f"WITH s AS (SELECT event_id, event_type, {_signals_sql(_REPLAY)} FROM events) SELECT event_id, error, reward, harm FROM s WHERE error >= 0.25 OR reward >= 0.6 OR harm >= 0.3 OR event_type = 'error' OR event_id % 17 = 0"


def contradictions(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    edges = e.select(
        F.col("event_id").alias("edge_id"),
        (F.col("user_id") % 50).alias("source"),
        (F.col("event_id") % 20).alias("target"),
        F.when(F.col("event_id") % 7 == 0, "does_not_provide").otherwise("provide").alias("relation"),
        F.array((F.col("event_id") % 6).cast("string"), (F.col("event_id") % 9).cast("string")).alias("scope"),
        F.when(F.col("event_type") == "view", "suppressed").otherwise("active").alias("status"),
    )
    return P.contradictions(edges)


CONTRADICTIONS = """WITH e AS (SELECT event_id AS edge_id, user_id % 50 AS source, event_id % 20 AS target, event_id % 7 = 0 AS neg, [event_id % 6, event_id % 9] AS scope FROM events WHERE event_type <> 'view'),
b AS (SELECT y.edge_id AS y, n.edge_id AS n FROM e y JOIN e n ON y.source = n.source AND y.target = n.target AND NOT y.neg AND n.neg AND list_has_any(y.scope, n.scope))
SELECT y AS edge_id, 'testing' AS status FROM b UNION SELECT n, 'testing' FROM b"""


def hot_paths(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return P.hot_paths(e, ["user_id"], F.col("event_type") != "error", (F.col("event_id") * 3 % 101) / F.lit(100.0), 0.5)


HOT_PATHS = """SELECT user_id, count(*) AS use_count, round(avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS success_rate, round(avg((event_id * 3 % 101) / 100.0::DOUBLE), 6) AS mean_cost
FROM events GROUP BY user_id HAVING count(*) >= 5 AND success_rate >= 0.8 AND mean_cost >= 0.5"""


def efficiency_metrics(spark, sf_dir):
    i = F.col("event_id")
    rows = _read(spark, sf_dir, "events").select((i % 2 == 0).alias("retrieved"), (i % 4 == 0).alias("used"), (i % 10 == 0).alias("repeated"), (i % 12 == 0).alias("full_read"), (i % 7).alias("branches"), (i % 5 == 0).cast("int").alias("sessions"), (i % 50 == 0).cast("int").alias("lessons"), (i % 3 == 0).cast("int").alias("decisions"), (i % 15 == 0).cast("int").alias("reversals"))
    return P.efficiency(rows)


EFFICIENCY = """SELECT round(count(*) FILTER (event_id % 2 = 0 AND event_id % 4 <> 0) / nullif(count(*) FILTER (event_id % 2 = 0), 0), 6) AS unused_retrieval_ratio,
round(count(*) FILTER (event_id % 10 = 0 AND event_id % 2 = 0) / nullif(count(*) FILTER (event_id % 2 = 0), 0), 6) AS duplicate_context_ratio,
round(count(*) FILTER (event_id % 12 = 0 AND event_id % 2 = 0) / nullif(count(*) FILTER (event_id % 2 = 0), 0), 6) AS full_file_read_ratio,
round(avg(event_id % 7), 6) AS average_simulation_branches,
round(count(*) FILTER (event_id % 5 = 0) / nullif(count(*) FILTER (event_id % 50 = 0), 0), 6) AS session_to_lesson_ratio,
round(count(*) FILTER (event_id % 15 = 0) / nullif(count(*) FILTER (event_id % 3 = 0), 0), 6) AS decision_reversal_rate FROM events"""


def lifecycle_steps(spark, sf_dir):
    names = ["proposed", "authorized", "active", "achieved", "verified"]
    c = _read(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.element_at(F.array(*map(F.lit, names)), ((F.col("turn") + F.when(F.col("conv_id") % 3 == 0, F.col("turn")).otherwise(0)) % 5 + 1).cast("int")).alias("status"))
    return L.transitions(rows, ["conv_id"], ["turn"], "status").select("conv_id", "turn", "status", "before", "allowed")


LIFECYCLE = """WITH r AS (SELECT conv_id, turn, ['proposed', 'authorized', 'active', 'achieved', 'verified'][(turn + CASE WHEN conv_id % 3 = 0 THEN turn ELSE 0 END) % 5 + 1] AS status FROM conversations),
b AS (SELECT *, lag(status) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM r)
SELECT *, coalesce(before = status OR (before, status) IN (('proposed','authorized'),('authorized','active'),('active','achieved'),('achieved','verified')), true) AS allowed FROM b"""



def outcome_rewards(spark, sf_dir):
    """The reward of an event's outcome; none for one that isn't in the table."""
    names = F.array(*map(F.lit, [*C.OUTCOME_REWARD, "other"]))
    outcome = F.element_at(names, (F.col("event_id") % 9 + 1).cast("int"))
    return _read(spark, sf_dir, "events").select("event_id", S.lookup(outcome, C.OUTCOME_REWARD).alias("reward"))


OUTCOME_REWARDS = f"SELECT event_id, [{', '.join(str(v) for v in C.OUTCOME_REWARD.values())}, NULL][event_id % 9 + 1]::DOUBLE AS reward FROM events"


def hypothesis_steps(spark, sf_dir):
    names = F.array(*map(F.lit, ["Proposed", "Testing", "Confirmed", "Refuted"]))
    turn = F.col("turn")
    step = F.when(F.col("conv_id") % 3 == 0, turn % 4).when((F.col("conv_id") % 3 == 1) & (turn == 2), F.lit(3)).otherwise(F.least(turn, F.lit(2)))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(names, (step + 1).cast("int")).alias("status"))
    return L.transitions(rows, ["conv_id"], ["turn"], "status", C.HYPOTHESIS_STEPS).select("conv_id", "turn", "status", "before", "allowed")


HYPOTHESES = f"""WITH r AS (SELECT conv_id, turn, ['Proposed', 'Testing', 'Confirmed', 'Refuted'][CASE WHEN conv_id % 3 = 0 THEN turn % 4 WHEN conv_id % 3 = 1 AND turn = 2 THEN 3 ELSE least(turn, 2) END + 1] AS status FROM conversations),
b AS (SELECT *, lag(status) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM r)
SELECT *, coalesce(before = status OR (before, status) IN ({', '.join(f"('{a}', '{b}')" for a, b in C.HYPOTHESIS_STEPS)}), true) AS allowed FROM b"""


def level_quotas(spark, sf_dir):
    """Reads by level: sections share a quota, whether matching or adjacent."""
    rows = _candidates(spark, sf_dir).withColumn("level", S.retrieval_level(F.col("activation")))
    return R.within_levels(rows, ["label"], "activation", "vec_id").select("label", "level", "vec_id", "activation", "quota_rank")


LEVEL_QUOTAS = f"""WITH {_candidates_sql()}, k AS (SELECT *, {_LEVEL_SQL.format(a='activation')} AS level FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY label, replace(level, 'adjacent_sections', 'matching_section') ORDER BY activation DESC, vec_id) AS quota_rank FROM k WHERE level <> 'ignore')
SELECT label, level, vec_id, activation, quota_rank FROM r WHERE quota_rank <= CASE level WHEN 'index_only' THEN 12 WHEN 'frontmatter' THEN 6 WHEN 'full_concept' THEN 1 ELSE 4 END"""


def cognitive_efficiency(spark, sf_dir):
    """Quality of each user's events over what they cost; every fifth user costs nothing."""
    i = F.col("event_id")
    rows = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(i % 7).alias("quality"), F.sum(F.when(F.col("user_id") % 5 == 0, 0).otherwise(i % 3 + 1)).alias("cost"))
    return rows.select("user_id", F.round(P.cognitive_efficiency(F.col("quality"), F.col("cost")), 6).alias("efficiency"))


EFFICIENCY_OF_USERS = "SELECT user_id, round(sum(event_id % 7)::DOUBLE / nullif(sum(CASE WHEN user_id % 5 = 0 THEN 0 ELSE event_id % 3 + 1 END), 0)::DOUBLE, 6) AS efficiency FROM events GROUP BY user_id"


def assembly_nodes(spark, sf_dir):
    nodes = _candidates(spark, sf_dir).select("label", F.col("vec_id").alias("ref"), "activation", F.when(F.col("vec_id") % 2 == 0, "domain").otherwise("method").alias("role"))
    out = P.assembly(nodes, ["label"])
    return out.select("label", F.array_join(F.transform("nodes", lambda n: F.concat_ws(":", n["ref"].cast("string"), n["role"])), ",").alias("nodes"))


ASSEMBLY = f"""WITH {_candidates_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY activation DESC, vec_id) AS rank FROM c)
SELECT label, string_agg(vec_id || ':' || CASE WHEN vec_id % 2 = 0 THEN 'domain' ELSE 'method' END, ',' ORDER BY rank) AS nodes FROM r WHERE rank <= 8 GROUP BY label"""


def workspace_limits(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    kinds = F.array(*map(F.lit, [*C.WORKSPACE_LIMITS, "other"]))
    items = e.select("user_id", "event_id", F.element_at(kinds, (F.col("event_id") % 8 + 1).cast("int")).alias("kind"), ((F.col("event_id") * 7) % 101).alias("priority"))
    return P.workspace(items, ["user_id"], "kind", "priority", "event_id")


WORKSPACE = f"""WITH i AS (SELECT user_id, event_id, [{", ".join(f"'{k}'" for k in [*C.WORKSPACE_LIMITS, "other"])}][event_id % 8 + 1] AS kind, (event_id * 7) % 101 AS priority FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY priority DESC, event_id) AS rank FROM i)
SELECT * FROM r WHERE rank <= CASE kind {" ".join(f"WHEN '{k}' THEN {n}" for k, n in C.WORKSPACE_LIMITS.items())} ELSE 0 END"""


def narrative_self(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return P.narrative(e.select("event_type", (F.col("event_id") % 300).alias("subject"), "user_id"), "event_type", "subject", "user_id")


NARRATIVE = "SELECT event_type, event_id % 300 AS subject, count(DISTINCT user_id) AS sessions, count(DISTINCT user_id) >= 2 AS recurs FROM events GROUP BY ALL"


def cognitive_budget(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    stage = F.element_at(F.array(*map(F.lit, C.BUDGET_SPLIT)), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", F.coalesce(S.cognitive_budget(F.col("event_id") % 6, stage), F.lit(-1)).alias("percent"))


COGNITIVE_BUDGET = f"""SELECT event_id, CASE WHEN event_id % 6 > 4 THEN -1 ELSE ([{", ".join(str(list(v)) for v in C.BUDGET_SPLIT.values())}])[event_id % 7 + 1][event_id % 6 + 1] END AS percent FROM events"""


def edge_terms(spark, sf_dir):
    """Initial weight and independence by situation, and content that is filed as an observation but isn't one."""
    i = F.col("event_id")
    def pick(names, n):
        return F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))

    status = pick(C.EPISTEMIC, 7)
    return _read(spark, sf_dir, "events").select("event_id", S.lookup(pick(C.INITIAL_WEIGHT, 6), C.INITIAL_WEIGHT).alias("initial"), S.lookup(pick(C.INDEPENDENCE, 5), C.INDEPENDENCE).alias("independence"), S.misfiled(status, F.when(i % 3 == 0, "observed").otherwise("inferred")).alias("misfiled"))


EDGE_TERMS = f"""SELECT event_id, {list(C.INITIAL_WEIGHT.values())}[event_id % 6 + 1]::DOUBLE AS initial, {list(C.INDEPENDENCE.values())}[event_id % 5 + 1]::DOUBLE AS independence,
event_id % 3 = 0 AND event_id % 7 <> 0 AS misfiled FROM events"""


def resume_state(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    memory = L.merge_deltas(e.select(F.when(F.col("event_id") % 2 == 0, "focus").otherwise("next_action").alias("key"), F.col("props").alias("value"), "ts", "event_id"), ["key"], F.struct("ts", "event_id"), "value")
    return L.resume_state(e, memory, ["user_id"], F.struct("ts", "event_id"), "event_type")


RESUME_STATE = """WITH m AS (SELECT arg_max(props, (ts, event_id)) FILTER (event_id % 2 = 0) AS focus, arg_max(props, (ts, event_id)) FILTER (event_id % 2 = 1) AS next_action FROM events),
r AS (SELECT user_id, count(*) AS event_count, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY user_id) SELECT r.*, m.* FROM r, m"""

LEDGER = {
    "assembly_nodes": (assembly_nodes, ASSEMBLY),
    "workspace_limits": (workspace_limits, WORKSPACE),
    "narrative_self": (narrative_self, NARRATIVE),
    "cognitive_budget": (cognitive_budget, COGNITIVE_BUDGET),
    "edge_terms": (edge_terms, EDGE_TERMS),
    "resume_state": (resume_state, RESUME_STATE),
    "activation_levels": (activation_levels, ACTIVATION_LEVELS),
    "progressive_retrieve": (progressive_retrieve, PROGRESSIVE),
    "retrieval_quotas": (retrieval_quotas, QUOTAS),
    "salience_gate": (salience_gate, SALIENCE_GATE),
    "goal_priority": (goal_priority, GOAL_PRIORITY),
    "decision_score": (decision_score, DECISION_SCORE),
    "risk_mode_score": (risk_mode_score, RISK_MODE_SCORE),
    "option_shortlist": (option_shortlist, OPTION_SHORTLIST),
    "expected_value": (expected_value, EXPECTED_VALUE),
    "reward_score": (reward_score, REWARD_SCORE),
    "state_actions": (state_actions, STATE_ACTIONS),
    "ledger_resume": (ledger_resume, LEDGER_RESUME),
    "working_memory_latest": (working_memory_latest, WORKING_MEMORY),
    "prediction_error": (prediction_error, PREDICTION_ERROR),
    "edge_weights": (edge_weights, EDGE_WEIGHTS),
    "ledger_stream_replay": (ledger_stream_replay, STREAM_REPLAY),
    "ledger_resumed_stream": (ledger_resumed_stream, EDGE_WEIGHTS),
    "ledger_events": (ledger_events, LEDGER_EVENTS),
    "outcome_rewards": (outcome_rewards, OUTCOME_REWARDS),
    "hypothesis_steps": (hypothesis_steps, HYPOTHESES),
    "level_quotas": (level_quotas, LEVEL_QUOTAS),
    "cognitive_efficiency": (cognitive_efficiency, EFFICIENCY_OF_USERS),
    "edge_insert_or_ignore": (edge_insert_or_ignore, INSERT_OR_IGNORE),
    "consolidate_status": (consolidate_status, CONSOLIDATE_STATUS),
    "consolidate_counts": (consolidate_counts, CONSOLIDATE_COUNTS),
    "eligibility_credit": (eligibility_credit, ELIGIBILITY_CREDIT),
    "lesson_candidates": (lesson_candidates, LESSON_CANDIDATES),
    "skill_promotion": (skill_promotion, SKILL_PROMOTION),
    "replay_selection": (replay_selection, REPLAY_SELECTION),
    "contradictions": (contradictions, CONTRADICTIONS),
    "hot_paths": (hot_paths, HOT_PATHS),
    "efficiency_metrics": (efficiency_metrics, EFFICIENCY),
    "lifecycle_steps": (lifecycle_steps, LIFECYCLE),
}
