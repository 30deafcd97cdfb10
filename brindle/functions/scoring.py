"""Weighted scores, ladders and clamps as columns. Terms are added in the order of the weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def linear(weights: dict[str, float], signal=F.col) -> Column:
    """Sum of weight * signal; a missing signal is 0. signal gives a name's column."""
    terms = [F.lit(w) * F.coalesce(signal(k).cast("double"), F.lit(0.0)) for k, w in weights.items()]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def from_map(m: Column):
    """Signals held in a map from name to value."""
    return lambda k: m[k]


def ladder(x: Column, steps, top: str) -> Column:
    """The name of the first step that x is below; top if none. Half-open: a bound belongs to the step above."""
    out = F.lit(top)
    for bound, name in reversed(steps):
        out = F.when(x < bound, name).otherwise(out)
    return out


def activation(signal=F.col) -> Column:
    return clamp(linear(C.ACTIVATION, signal))


def retrieval_level(a: Column, adjust: Column | float = 0.0) -> Column:
    return ladder(a - adjust, C.LEVELS, C.TOP_LEVEL)


def salience(signal=F.col) -> Column:
    return clamp(linear(C.SALIENCE, signal))


def attention(s: Column) -> Column:
    return F.when(s < C.ATTENTION_LOW, "log_only").when(s >= C.ATTENTION_HIGH, "workspace").otherwise("watch")


def confidence_bucket(c: Column) -> Column:
    return ladder(c, C.CONFIDENCE, C.CONFIDENCE_TOP)


def dynamic_threshold(pressure: Column, noise: Column, low_value: Column, explicit: Column) -> Column:
    """0.50 + adjustments, 0.15 less for an explicit reference."""
    return F.lit(0.50) + pressure + noise + low_value - F.when(explicit, 0.15).otherwise(0.0)


def pressure_adjust(pressure: Column) -> Column:
    return F.when(pressure >= 0.70, 0.10).otherwise(0.0)


def goal_priority(signal=F.col) -> Column:
    return linear(C.GOAL, signal)


def authority(source: Column) -> Column:
    return lookup(source, C.AUTHORITY)


def decision_score(signal=F.col) -> Column:
    """Null (eliminated) where policy_violation is over 0."""
    return F.when(F.coalesce(signal("policy_violation").cast("double"), F.lit(0.0)) <= 0, linear(C.DECISION, signal))


def risk_mode_score(mode: str, signal=F.col) -> Column:
    """decision_score with the mode's factors on risk, information gain and reversibility."""
    risk, gain, back = C.RISK_MODES[mode]
    factor = {"risk": risk, "information_gain": gain, "reversibility": back}
    return decision_score(lambda k: signal(k) * factor[k] if k in factor else signal(k))


def reward(signal=F.col) -> Column:
    return clamp(linear(C.REWARD, signal), -1.0, 1.0)


def eligibility(strength: Column, steps: Column, relevance: Column) -> Column:
    return strength * F.exp(-steps / 5.0) * relevance


def weight_change(reward_: Column, eligibility_: Column, confidence: Column, independence: Column) -> Column:
    """Learning step of an edge; null where eligibility is under the bound. A reward of 0 counts as a success."""
    rate = F.when(reward_ >= 0, C.POSITIVE_RATE).otherwise(C.NEGATIVE_RATE)
    return F.when(eligibility_ >= C.MIN_ELIGIBILITY, rate * reward_ * eligibility_ * confidence * independence)


def edge_status(weight: Column, success: Column, failure: Column, contradiction: Column, unused_days: Column, unique: Column) -> Column:
    """suppressed before archived, else active."""
    bad = ((failure >= C.SUPPRESS_FAILURES) & (success == 0)) | (contradiction >= C.SUPPRESS_CONTRADICTION)
    old = (weight < C.PRUNE_WEIGHT) & (F.coalesce(unused_days, F.lit(0)) > C.PRUNE_DAYS) & (success == 0) & (unique == 0)
    return F.when(bad, "suppressed").when(old, "archived").otherwise("active")


def state_actions(pressure: Column, uncertainty: Column, same_failures: Column) -> Column:
    """Actions that the internal state asks for, in order."""
    found = F.array(
        F.when(pressure >= 0.70, F.lit("raise_thresholds")),
        F.when(pressure >= 0.70, F.lit("no_full_reads")),
        F.when(pressure >= 0.80, F.lit("handoff")),
        F.when(uncertainty >= 0.65, F.lit("verify")),
        F.when(same_failures >= 2, F.lit("inhibit_strategy")),
    )
    return F.filter(found, lambda x: x.isNotNull())


def lookup(name: Column, values: dict[str, float]) -> Column:
    """The value of a name; null for others."""
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def cognitive_budget(task_class: Column, stage: Column) -> Column:
    """Percent of the budget of a task class (0 to 4) that a stage gets; null outside the table."""
    out = F.lit(None).cast("int")
    for name, shares in C.BUDGET_SPLIT.items():
        out = F.when((stage == name) & task_class.between(0, 4), F.get(F.array(*map(F.lit, shares)), task_class.cast("int"))).otherwise(out)
    return out


def misfiled(status: Column, stored_as: Column) -> Column:
    """Whether content is stored as an observation that isn't one; an unknown status counts as one that isn't."""
    return (stored_as == "observed") & ~F.coalesce(status, F.lit("unknown")).isin("observed")
