"""Mixing sources to target weights by hierarchical budgeting.

Sources stand in a tree: domain, language, source. A token budget goes down the tree by integer weights. A node can take
max_epochs times the tokens below it; what it can't take goes to its siblings by their weights, and only what a whole
subtree can't take goes to the siblings of its ancestor. Each level is solved in closed form: a child is full if the
budget suffices to raise all children, by weight, to its level. Allotments are rounded down, so under one token a
child stays unspent.

A leaf's allotment is a whole number of epochs and a token-prefix of one more. An epoch orders the leaf's documents by a
seeded hash of epoch and doc_id, and its prefix holds the documents whose running token count stays within the rest.
The cut is found from token sums of 4096 hash ranges, first among 64 steps of 64 and then within one; only the range
that the cut falls in is sorted, so no leaf is ever gathered in one task, however large.

Defined results: tokens are words; a null text counts as empty; null domain, language or source is the node ''; a node
without a weight has weight 1; one of weight 0 gets nothing, nor does what lies below it, and its documents come out
with no copies. A document of no tokens is taken where its place is in the
prefix. Rows that repeat a doc_id, or lack one, stand next to each other in an epoch's order. An empty table gives an empty result.
DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MINE, materialise, scratch, table

LEVELS = ("domain", "lang", "source")
NODES = tuple(f"{MINE}{x}" for x in LEVELS)
#: Of the 4096 hash ranges of a leaf (three hexadecimal digits), how many a coarse step holds.
STEP = 64
#: Leaves that are broadcast at most (their rows are under 200 bytes); more are joined by a shuffle.
MOST_LEAVES = 20_000


@dataclass(frozen=True)
class MixConfig:
    #: The budget as a share of all tokens (two integers, so that it is exact).
    share: tuple[int, int] = (4, 5)
    max_epochs: int = 2
    seed: int = 17
    #: Weights of nodes by their name at each level.
    weights: dict[str, dict[str, int]] = field(
        default_factory=lambda: {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
    )


def domain_of(source: Column) -> Column:
    """The domain of a source, by its number: thirds of the sources are web, books and forum."""
    n = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(n == "", "web").otherwise(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forum")), (n.cast("int") % 3 + 1)))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weight_of(level: str, node: Column, config: MixConfig) -> Column:
    out = F.lit(1)
    for name, w in config.weights.get(level, {}).items():
        out = F.when(node == name, w).otherwise(out)
    return out.cast("decimal(6,0)")


def fill(children: DataFrame, parent: list[str], node: str) -> DataFrame:
    """Adds allot to children (columns parent, node, w, cap, budget): their parent's budget by weight, none over cap.

    Children of one parent with the same weight and capacity get the same, so they stand as one row with their number:
    what one task sorts is the different sizes below a parent, not its children. One of weight 0 gets nothing.
    """
    alike = children.groupBy(*parent, "w", "cap").agg(F.count(F.lit(1)).alias("n"), F.max("budget").alias("budget"))
    order = W.partitionBy(*parent).orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), "w", "cap")
    upto, every = order.rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy(*parent)
    caps, weights = (F.expr(f"cast({c} * n as decimal(24,0))") for c in ("cap", "w"))
    out = alike.where("w > 0").withColumns({"caps": caps, "ws": weights}).withColumn("c_upto", F.sum("caps").over(upto)).withColumn("w_after", F.sum("ws").over(every) - F.sum("ws").over(upto))
    out = out.withColumn("full", F.expr("c_upto * w + cap * w_after <= budget * w"))
    left = F.col("budget") - F.sum(F.when(F.col("full"), F.col("caps")).otherwise(0)).over(every)
    out = out.withColumn("left", left.cast("decimal(20,0)")).withColumn("w_open", F.sum(F.when(~F.col("full"), F.col("ws")).otherwise(0)).over(every).cast("decimal(18,0)"))
    out = out.select(*parent, "w", "cap", F.expr("CASE WHEN full THEN cap ELSE (left * w) div w_open END").cast("decimal(20,0)").alias("allot"))
    zero = F.lit(0).cast("decimal(20,0)")
    return children.where("w > 0").join(out, [*parent, "w", "cap"]).unionByName(children.where("w = 0").withColumn("allot", zero))


def allot(leaves: DataFrame, config: MixConfig) -> DataFrame:
    """Leaves (node columns, tokens) with allot, whole epochs and rest of each."""
    cap = (F.sum("tokens") * config.max_epochs).cast("decimal(20,0)").alias("cap")
    total = (F.sum("tokens") * config.share[0]).alias("t")
    leaves = materialise(leaves, "mix-counts")
    budget = leaves.agg(total).select(F.expr(f"coalesce(t div {config.share[1]}, 0)").cast("decimal(20,0)").alias("budget"))
    above, parent = budget.withColumn("root", F.lit(0)), ["root"]
    base = leaves.withColumn("root", F.lit(0))
    for level, node in zip(LEVELS, NODES, strict=True):
        nodes = base.groupBy(*parent, node).agg(cap).withColumn("w", weight_of(level, F.col(node), config))
        children = materialise(nodes.join(above.select(*parent, "budget"), parent), "mix-nodes")
        above = fill(children, parent, node).select(*parent, node, F.col("allot").alias("budget"))
        parent = [*parent, node]
    out = leaves.join(above, list(NODES))
    epochs = F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END")
    return out.select(*NODES, "tokens", F.col("budget").cast("long").alias("allot"), epochs.alias("epochs")).withColumn("rest", F.col("allot") - F.col("epochs") * F.col("tokens"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with its node columns and token count."""
    source = F.coalesce(docs["source"], F.lit(""))
    return docs.withColumns({NODES[0]: domain_of(source), NODES[1]: F.coalesce(docs["lang"], F.lit("")), NODES[2]: source, f"{MINE}tokens": word_count(docs["text"])})


def placed(rows: DataFrame, cuts: DataFrame, config: MixConfig) -> DataFrame:
    """rows joined to their leaf, with their hash in the leaf's last epoch and its range."""
    key = F.md5(F.concat_ws(":", F.lit(config.seed), F.col(f"{MINE}epochs"), F.col("doc_id").cast("string")).cast("binary"))
    out = rows.join(cuts, list(NODES)).withColumn(f"{MINE}key", key)
    return out.withColumn(f"{MINE}range", F.conv(F.substring(f"{MINE}key", 1, 3), 16, 10).cast("int"))


def small(leaves: DataFrame) -> DataFrame:
    """Broadcast behind a check of its size."""
    return F.broadcast(leaves) if leaves.limit(MOST_LEAVES + 1).count() <= MOST_LEAVES else leaves


def _cut(sums: DataFrame, by: str) -> DataFrame:
    """(nodes, cut, before): the first part (by) of each leaf that passes its rest, and the tokens before it. start is
    what comes before all parts."""
    upto = F.col("start") + F.sum("sum").over(W.partitionBy(*NODES).orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow))
    over = sums.withColumn("upto", upto).where("upto > rest")
    return over.groupBy(*NODES).agg(F.min(by).alias("cut"), F.min(F.col("upto") - F.col("sum")).alias("before"))


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> tuple[DataFrame, DataFrame]:
    """(every document's leaf, tokens and copies: how often the mix takes it; the leaves and their allotments)."""
    with scratch(docs.sparkSession):
        return _mix(docs, config)


def _mix(docs: DataFrame, config: MixConfig) -> tuple[DataFrame, DataFrame]:
    t, e, k, r = (f"{MINE}{x}" for x in ("tokens", "epochs", "key", "range"))
    rows = materialise(keyed(docs).select("doc_id", *NODES, t), "mix-rows", keep=True)
    leaves = materialise(allot(rows.groupBy(*NODES).agg(F.sum(t).alias("tokens")), config), "mix-leaves", keep=True)
    terms = leaves.select(*NODES, F.col("epochs").alias(e), F.col("rest").alias(f"{MINE}rest"))
    at = placed(rows, small(terms), config)
    sums = materialise(at.groupBy(*NODES, r).agg(F.sum(t).alias("sum"), F.max(f"{MINE}rest").alias("rest")), "mix-ranges")
    coarse = _cut(sums.groupBy(*NODES, F.expr(f"{r} div {STEP}").alias("step")).agg(F.sum("sum").alias("sum"), F.max("rest").alias("rest"), F.lit(0).cast("long").alias("start")), "step")
    coarse = materialise(coarse.select(*NODES, F.col("cut").alias("step"), F.col("before").alias("start")), "mix-steps")
    fine = _cut(sums.join(small(coarse), list(NODES)).where(F.expr(f"{r} div {STEP}") == F.col("step")), r)
    cut = fine.select(*NODES, F.col("cut").alias(f"{MINE}cut"), F.col("before").alias(f"{MINE}before"))
    terms = materialise(terms.join(cut, list(NODES), "left"), "mix-cuts", keep=True)
    at = placed(rows, small(terms), config)
    whole = at.where(F.coalesce(F.col(r) != F.col(f"{MINE}cut"), F.lit(True))).withColumn("in", F.coalesce(F.col(r) < F.col(f"{MINE}cut"), F.lit(True)))
    run = F.sum(t).over(W.partitionBy(*NODES).orderBy(k, "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = at.where(F.col(r) == F.col(f"{MINE}cut")).withColumn("in", run + F.col(f"{MINE}before") <= F.col(f"{MINE}rest"))
    both = whole.select("doc_id", *NODES, t, e, "in").unionByName(edge.select("doc_id", *NODES, t, e, "in"))
    found = both.select("doc_id", *(F.col(n).alias(x) for n, x in zip(NODES, LEVELS, strict=True)), F.col(t).alias("n_tokens"), (F.col(e) + F.col("in").cast("long")).alias("copies"))
    return found, leaves


def select(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns, as often as it takes them."""
    found, _ = mix(docs, config)
    taken = found.where("copies > 0").groupBy(F.col("doc_id").alias(f"{MINE}id")).agg(F.max("copies").alias(f"{MINE}copies"))
    out = docs.join(taken, docs["doc_id"].eqNullSafe(taken[f"{MINE}id"]))
    if config.max_epochs > 1:
        out = out.withColumn(f"{MINE}n", F.explode(F.sequence(F.lit(1), F.col(f"{MINE}copies"))))
    return out.select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0]


def _fill_sql(name: str, source: str, above: str, parent: str, node: str, weight: str) -> str:
    on = " AND ".join(f"a.{p} = n.{p}" for p in parent.split(", "))
    return f"""
{name}_n AS (SELECT {parent}, {node}, sum(tokens)::HUGEINT * 2 AS cap, ({weight})::HUGEINT AS w FROM {source} GROUP BY ALL),
{name}_o AS (SELECT n.*, a.budget, sum(cap) OVER u AS c_upto, (sum(w) OVER p - sum(w) OVER u) AS w_after
  FROM {name}_n n JOIN {above} a ON {on}
  WINDOW u AS (PARTITION BY {', '.join('n.' + p for p in parent.split(', '))} ORDER BY cap::DOUBLE / w::DOUBLE, {node} ROWS UNBOUNDED PRECEDING),
         p AS (PARTITION BY {', '.join('n.' + p for p in parent.split(', '))})),
{name}_f AS (SELECT *, c_upto * w + cap * w_after <= budget * w AS is_full FROM {name}_o),
{name} AS (SELECT {parent}, {node}, CASE WHEN is_full THEN cap ELSE
    ((budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER q)::HUGEINT * w) // nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER q, 0)::HUGEINT END AS budget
  FROM {name}_f WINDOW q AS (PARTITION BY {parent}))"""


def _mix_sql(docs: str) -> str:
    return f"""d AS (
  SELECT doc_id, 0 AS root, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'web'
      ELSE ['web', 'books', 'forum'][(regexp_extract(source, '([0-9]+)$', 1)::INT % 3) + 1] END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
  FROM {docs}
), leaf AS (SELECT root, domain, lang, source, sum(tokens)::HUGEINT AS tokens FROM d GROUP BY ALL),
top AS (SELECT 0 AS root, (sum(tokens) * 4) // 5 AS budget FROM leaf),
{_fill_sql("l1", "leaf", "top", "root", "domain", "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'forum' THEN 2 ELSE 1 END")},
{_fill_sql("l2", "leaf", "l1", "root, domain", "lang", "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END")},
{_fill_sql("l3", "leaf", "l2", "root, domain, lang", "source", "1")},
term AS (SELECT f.domain, f.lang, f.source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
    budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest
  FROM leaf f JOIN l3 USING (domain, lang, source)),
o AS (SELECT d.*, t.epochs, t.rest, sum(d.tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('17:' || t.epochs || ':' || d.doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN term t ON d.domain = t.domain AND d.lang = t.lang AND d.source = t.source)"""


OP8_SQL = f"""WITH {_mix_sql("documents")}
SELECT doc_id, domain, lang, source, tokens AS n_tokens, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM o"""
