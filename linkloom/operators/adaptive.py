"""What is learned over time: priors, decay, adaptive thresholds, uncertainty, aliases, examples, circuit breakers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.text import normalize_for_matching
from linkloom.operators.folds import folded
from linkloom.operators.relational import top_k


def blended_weight(learned: Column, prior: Column, samples: Column, days: Column, strength: float, half_life: float = 14.0, least: int = 20) -> Column:
    """The prior under `least` samples; from then on a mean of both in which the prior's strength halves every half_life days."""
    held = strength * F.pow(F.lit(0.5), days / half_life)
    share = held / (samples + held)
    return F.when(samples < least, prior).otherwise((1 - share) * learned + share * prior)


def decayed_affinity(score: Column, days: Column, rate: float = 0.01, stale: int = 90) -> Column:
    """Moves by rate * days toward 0.5 and not past it; 0.5 after `stale` days."""
    step = rate * days
    moved = F.when(score > 0.5, F.greatest(score - step, F.lit(0.5))).otherwise(F.least(score + step, F.lit(0.5)))
    return F.when(days > stale, 0.5).when(days > 0, moved).otherwise(score)


def historical_bonus(score: Column, confirmed: Column, n: Column, weight: float = 0.1, least: int = 5, least_confirmed: int = 3) -> Column:
    """From -weight to +weight by the affinity; 0 with too little feedback, or few confirmations and no low affinity."""
    applies = (n >= least) & ((confirmed >= least_confirmed) | (score < 0.5))
    return F.when(applies, (score - 0.5) * 2.0 * weight).otherwise(0.0)


def threshold_levels(start: float, step: float, low: float, high: float) -> tuple[list[float], list[int], list[int]]:
    """All values that steps within the bounds reach from start, and the index of each one's next lower and higher value."""
    move = lambda v, d: round(min(high, max(low, v + d)), 9)
    found, todo = {round(start, 9)}, [round(start, 9)]
    while todo:
        v = todo.pop()
        for w in (move(v, -step), move(v, step)):
            if w not in found:
                found.add(w)
                todo.append(w)
    levels = sorted(found)
    return levels, [levels.index(move(v, -step)) for v in levels], [levels.index(move(v, step)) for v in levels]


def adaptive_thresholds(df: DataFrame, keys: list[str], order: list[str], score: str, window: int = 100, start: float = 0.70, step: float = 0.02, low: float = 0.30, high: float = 0.95, target: float = 0.85, tolerance: float = 0.05) -> DataFrame:
    """(keys, window, threshold, accepted, total, next): after each full window of scores the threshold falls if too few
    were accepted and rises if too many were.

    How many scores of a window each reachable threshold accepts is counted first; what is folded in order is one row a
    window. Null scores are never accepted; a last window that isn't full changes nothing.
    """
    levels, lower, higher = threshold_levels(start, step, low, high)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    per = df.withColumn("window", F.floor(nth / window).cast("long")).groupBy(*keys, "window")
    counts = per.agg(F.count("*").alias("total"), F.array(*[F.count_if(F.col(score) >= v) for v in levels]).alias("over"))

    def step(at: int, over: list[int], total: int) -> tuple[int, tuple[float, int, float]]:
        used, rate = at, over[at] / total
        if total >= window:
            at = lower[at] if rate < target - tolerance else higher[at] if rate > target + tolerance else at
        return at, (levels[used], over[used], levels[at])

    fields = [T.StructField("threshold", T.DoubleType()), T.StructField("accepted", T.LongType()), T.StructField("next", T.DoubleType())]
    out = folded(counts, keys, ["window"], ["over", "total"], fields, lambda: levels.index(round(start, 9)), step)
    return out.select(*keys, "window", "threshold", "accepted", "total", "next")


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1, both excluded, that is fixed by the parts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / float(16**12)


def gaussian(*parts: Column) -> Column:
    return F.sqrt(-2.0 * F.ln(uniform(*parts, F.lit("r")))) * F.cos(2.0 * math.pi * uniform(*parts, F.lit("a")))


def uncertainty(key: Column, parts: dict[str, Column], weights: dict[str, float], samples: int = 20, noise: float = 0.1, level: float = 0.95, most: float = 0.15, seed: int = 42) -> Column:
    """struct(original, mean, deviation, low, high, level, certain): the score under weights with Gaussian noise.

    Weights are moved by noise * weight, at least 0.001, and made to sum to 1. The noise is fixed by key, sample and
    seed, so that reruns agree. The interval is by percentiles under 30 samples, else by the normal approximation.
    """
    z = 2.576 if level >= 0.99 else 1.96 if level >= 0.95 else 1.645 if level >= 0.90 else 1.96

    def one(i: Column) -> Column:
        moved = {k: F.greatest(F.lit(0.001), w + gaussian(key, i, F.lit(k), F.lit(seed)) * noise * w) for k, w in weights.items()}
        # a struct, so that each weight's noise is worked out once
        s = F.struct(*[v.alias(k) for k, v in moved.items()])
        return F.transform(F.array(s), lambda m: sum(m[k] * parts[k] for k in moved) / sum(m[k] for k in moved))[0]

    drawn = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(samples)), one))

    def summary(a: Column) -> Column:
        mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / samples
        return F.transform(F.array(mean), lambda m: F.struct(m.alias("mean"), F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / samples).alias("deviation"), a.alias("drawn")))[0]

    original = sum(w * parts[k] for k, w in weights.items()) / sum(weights.values())
    alpha = 1 - level
    first, last = math.floor(alpha / 2 * samples), math.ceil((1 - alpha / 2) * samples) - 1

    def result(s: Column) -> Column:
        margin = z * s["deviation"] / math.sqrt(samples)
        small = samples < 30
        return F.struct(
            original.alias("original"),
            s["mean"].alias("mean"),
            s["deviation"].alias("deviation"),
            (s["drawn"][first] if small else s["mean"] - margin).alias("low"),
            (s["drawn"][last] if small else s["mean"] + margin).alias("high"),
            uncertainty_level(s["deviation"]).alias("level"),
            (s["deviation"] <= most).alias("certain"),
        )

    return F.transform(F.transform(F.array(drawn), summary), result)[0]


def uncertainty_level(deviation: Column) -> Column:
    return F.when(deviation < 0.05, "very_low").when(deviation < 0.10, "low").when(deviation < 0.15, "moderate").when(deviation < 0.20, "high").otherwise("very_high")


def agreement(scores: list[Column]) -> Column:
    """1 - 2 * the population deviation of the scores, which counts as 0.5 at most."""
    n = len(scores)
    mean = sum(scores) / n
    return 1 - 2 * F.least(F.sqrt(sum((s - mean) * (s - mean) for s in scores) / n), F.lit(0.5))


def learned_aliases(df: DataFrame, score: str, offer: str, request: str, offer_master: str, request_master: str, least: float = 0.85, confirmations: int = 2) -> DataFrame:
    """(alias, master, confirmations): names on the unresolved side of confirmed matches of which the other side is resolved."""
    one = df.filter((F.col(score) >= least) & (F.col(offer_master).isNull() != F.col(request_master).isNull()))
    unknown = F.when(F.col(offer_master).isNull(), F.col(offer)).otherwise(F.col(request))
    g = one.groupBy(normalize_for_matching(unknown).alias("alias"), F.coalesce(offer_master, request_master).alias("master")).agg(F.count("*").alias("confirmations"))
    return g.filter((F.col("confirmations") >= confirmations) & F.col("alias").isNotNull())


def examples_for(df: DataFrame, category: str, wanted: list[str], order: list[Column], count: int, corrections: str = "correction", edges: str = "edge") -> DataFrame:
    """At most `count` examples with place: count / 2 of each wanted category, then one correction, then one edge case."""
    most = {c: count // 2 for c in wanted} | {corrections: 1, edges: 1}
    at = {c: i for i, c in enumerate(most)}
    pick = lambda table: F.coalesce(*[F.when(F.col(category) == c, v) for c, v in table.items()])
    best = top_k(df.filter(F.col(category).isin(*most)), [category], order, max(count // 2, 1))
    few = best.filter(F.col("rank") <= pick(most)).withColumn("place", F.row_number().over(Window.orderBy(pick(at), "rank")))  # count + 2 rows at most
    return few.filter(F.col("place") <= count).drop("rank")


def circuit_states(df: DataFrame, keys: list[str], order: list[str], at: str, ok: str, failures: int = 3, reset_seconds: float = 30.0) -> DataFrame:
    """df with allowed and state (after the call), from the calls' outcomes in order.

    Closed until `failures` failures in a row; open, calls are refused and their outcomes don't count; over
    reset_seconds after the last failure one call is let through, which closes or opens it again. at: seconds.
    """

    def step(now: tuple[str, int, float], t: float, good: bool) -> tuple[tuple[str, int, float], tuple[bool, str]]:
        state, bad, last = now
        if state == "open" and t - last > reset_seconds:
            state = "half_open"
        allowed = state != "open"
        if allowed:
            bad, last = (0, last) if good else (bad + 1, t)
            state = "closed" if good else "open" if state == "half_open" or bad >= failures else state
        return (state, bad, last), (allowed, state)

    new = [T.StructField("allowed", T.BooleanType()), T.StructField("state", T.StringType())]
    return folded(df, keys, order, [at, ok], new, lambda: ("closed", 0, 0.0), step)
