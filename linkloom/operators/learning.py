"""Feedback statistics, calibration, affinities, tests and windows over ordered outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.scoring import normal_cdf
from linkloom.operators.folds import folded


def bins(df: DataFrame, score: Column, positive: Column, n: int = 10) -> DataFrame:
    """(bin, n, positives, mean_score, rate): equal bins by score / (1/n) in floating point, the last one closed."""
    k = F.least(F.floor(score / (1.0 / n)).cast("int"), F.lit(n - 1))
    return df.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.count_if(positive).alias("positives"), F.avg(score).alias("mean_score")).withColumn("rate", F.col("positives") / F.col("n"))


def calibration_error(binned: DataFrame) -> DataFrame:
    """(ece, mce): the mean gap of score and rate by rows, and the largest."""
    gap = F.abs(F.col("mean_score") - F.col("rate"))
    return binned.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"))


def calibrated(df: DataFrame, score: str, binned: DataFrame, least: int = 20, smoothing: float = 0.8, n: int = 10) -> DataFrame:
    k = F.least(F.floor(F.col(score) / (1.0 / n)).cast("int"), F.lit(n - 1))
    b = binned.select(F.col("bin").alias("__bin"), F.col("n").alias("__n"), "rate")
    joined = df.withColumn("__bin", k).join(F.broadcast(b), "__bin", "left")  # n rows
    return joined.withColumn("calibrated", F.when(F.col("__n") >= least, smoothing * F.col("rate") + (1 - smoothing) * F.col(score)).otherwise(F.col(score))).drop("__bin", "__n", "rate")


def factor_stats(df: DataFrame, factors: list[str], confirmed: Column) -> DataFrame:
    """(factor, avg_confirmed, avg_rejected, correlation): empty sides count as 0."""
    one = df.agg(*[F.coalesce(F.avg(F.when(c, F.col(f))), F.lit(0.0)).alias(f"{f}_{s}") for f in factors for s, c in (("c", confirmed), ("r", ~confirmed))])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"{f}_c").alias("avg_confirmed"), F.col(f"{f}_r").alias("avg_rejected")) for f in factors])).alias("x")).select("x.*")
    most = F.greatest("avg_confirmed", "avg_rejected")
    return rows.withColumn("correlation", F.when(most == 0, 0.0).otherwise((F.col("avg_confirmed") - F.col("avg_rejected")) / most))


def new_weights(stats: DataFrame, weights: DataFrame, rate: float = 0.1, least: float = 0.02, low: float = 0.05, high: float = 0.7, n: Column | None = None, least_n: int = 100) -> DataFrame:
    """(factor, weight, new_weight): w (1 + rate * correlation), small steps ignored, clamped, and made to sum to 1.

    n: how much feedback there is, a column of stats; under least_n weights stay.
    """
    known = F.lit(True) if n is None else n >= least_n
    j = weights.join(stats.select("factor", F.when(known, F.col("correlation")).otherwise(0.0).alias("correlation")), "factor", "left").withColumn("moved", F.col("weight") * (1 + rate * F.coalesce("correlation", F.lit(0.0))))
    j = j.withColumn("held", F.least(F.lit(high), F.greatest(F.lit(low), F.when(F.abs(F.col("moved") - F.col("weight")) < least, F.col("weight")).otherwise(F.col("moved")))))
    return j.select("factor", "weight", F.round(F.col("held") / F.sum("held").over(Window.partitionBy()), 6).alias("new_weight"))


def affinity(df: DataFrame, keys: list[str], at: str, tie: str, ok: Column, up: float = 0.1, down: float = 0.15) -> DataFrame:
    """(keys, n, confirmed, affinity): from 0.5, +up to at most 1 or -down to at least 0, in order of time.

    A row of steps is one function x -> min(high, max(low, x + shift)), and such functions compose. Steps are composed
    within a key's days first and then over its days, so that a key with very many outcomes is dealt to many tasks.
    """
    part = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), ok.alias("ok"))
    days = df.withColumn("day__", F.col(at).cast("date") if dict(df.dtypes)[at].startswith(("timestamp", "date")) else F.lit(0)).groupBy(*keys, "day__").agg(F.array_sort(F.collect_list(part)).alias("seq"), F.count("*").alias("n"), F.count_if(ok).alias("confirmed"))
    start = F.struct(F.lit(0.0).alias("shift"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def step(f: Column, x: Column) -> Column:
        rise = lambda c: F.least(F.lit(1.0), f[c] + up)
        fall = lambda c: F.greatest(F.lit(0.0), f[c] - down)
        return F.struct(F.when(x["ok"], f["shift"] + up).otherwise(f["shift"] - down).alias("shift"), F.when(x["ok"], rise("low")).otherwise(fall("low")).alias("low"), F.when(x["ok"], rise("high")).otherwise(fall("high")).alias("high"))

    whole = days.withColumn("f", F.aggregate("seq", start, step)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day__", "f"))).alias("fs"), F.sum("n").alias("n"), F.sum("confirmed").alias("confirmed"))
    value = F.aggregate("fs", F.lit(0.5), lambda x, d: F.least(d["f"]["high"], F.greatest(d["f"]["low"], x + d["f"]["shift"])))
    return whole.withColumn("affinity", value).drop("fs")


def two_proportions(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """struct(z, p): pooled two-proportion test, two tails."""
    pool = (k1 + k2) / (n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    z = F.when(se == 0, 0.0).otherwise((k2 / n2 - k1 / n1) / se)
    return F.struct(z.alias("z"), (2 * (1 - normal_cdf(F.abs(z)))).alias("p"))


def feedback_summary(df: DataFrame, factors: list[str], confirmed: Column) -> DataFrame:
    """factor_stats with (total, confirmed, rejected, rate) of all feedback and the difference of a factor's means, rounded."""
    n, yes = F.count("*"), F.count_if(confirmed)
    total = df.agg(n.alias("total"), yes.alias("confirmed"), F.count_if(~confirmed).alias("rejected"), F.round(F.when(n == 0, 0.0).otherwise(yes / n), 6).alias("rate"))
    r = lambda c: F.round(c, 6)
    rows = factor_stats(df, factors, confirmed).crossJoin(total)  # one row
    return rows.select("factor", "total", "confirmed", "rejected", "rate", r("avg_confirmed").alias("avg_confirmed"), r("avg_rejected").alias("avg_rejected"), r(F.col("avg_confirmed") - F.col("avg_rejected")).alias("difference"))


def rate_alerts(df: DataFrame, keys: list[str], at: str, hit: Column, seconds: int = 86400, least: int = 10, most: float = 0.1) -> DataFrame:
    """df with alert: over `most` hits among `least` rows or more of the last so many seconds."""
    w = Window.partitionBy(*keys).orderBy(F.unix_timestamp(F.col(at).cast("timestamp"))).rangeBetween(-seconds, 0)
    n, hits = F.count("*").over(w), F.count(F.when(hit, 1)).over(w)
    return df.withColumn("alert", (n >= least) & (hits / n > most))


def rolling(df: DataFrame, keys: list[str], order: list[str], value: str, recent: int = 10, least: int | None = None) -> DataFrame:
    """df with recent and before: means of the last `recent` values and of as many before those; and drop: a fall of over 20 %, from `least` rows on (2 * recent)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumns({"recent": F.avg(value).over(w.rowsBetween(1 - recent, 0)), "before": F.avg(value).over(w.rowsBetween(1 - 2 * recent, -recent)), "__n": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return out.withColumn("drop", F.coalesce((F.col("__n") >= (least or 2 * recent)) & (F.col("before") > 0) & ((F.col("before") - F.col("recent")) / F.col("before") > 0.2), F.lit(False))).drop("__n")


def runs(df: DataFrame, keys: list[str], order: list[str], hit: Column) -> DataFrame:
    """df with run: how many rows in a row met `hit`, this one included."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    g = df.withColumn("__hit", hit.cast("int")).withColumn("__island", F.sum(1 - F.col("__hit")).over(w))
    inside = Window.partitionBy(*keys, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("run", F.sum("__hit").over(inside)).drop("__hit", "__island")


def outliers(df: DataFrame, keys: list[str], order: list[str], value: str, window: int = 100, least: int = 20, z: float = 2.5) -> DataFrame:
    """df with outlier: by mean and population deviation of the last accepted values of its key; outliers don't enter, nor do nulls, which are none."""

    def step(held: list[float], v: float | None) -> tuple[list[float], tuple[bool]]:
        odd = False
        if v is not None and len(held) >= least:
            mean = sum(held) / len(held)
            dev = (sum((x - mean) ** 2 for x in held) / len(held)) ** 0.5
            odd = dev > 0 and abs(v - mean) / dev > z
        return (held if odd or v is None else (held + [v])[-window:]), (odd,)

    return folded(df, keys, order, [value], [T.StructField("outlier", T.BooleanType())], list, step)


def vote(approved: Column, rejected: Column, flagged: Column, least: float = 0.67) -> Column:
    """The majority's verdict (ties: approved, rejected, flagged); Flagged under `least` agreement or without votes."""
    total, most = approved + rejected + flagged, F.greatest(approved, rejected, flagged)
    name = F.when(approved == most, "Approved").when(rejected == most, "Rejected").otherwise("Flagged")
    return F.when((total == 0) | (most / total < least), "Flagged").otherwise(name)


def token_batches(df: DataFrame, keys: list[str], order: list[str], tokens: str, budget: int = 3000, most: int = 10) -> DataFrame:
    """df with batch: greedy batches in order, up to `budget` tokens and `most` rows; a row over the budget is alone."""

    def step(state: tuple[int, int, int], t: int | None) -> tuple[tuple[int, int, int], tuple[int]]:
        k, used, n = state
        t = t or 0
        if n and (used + t > budget or n >= most):
            k, used, n = k + 1, 0, 0
        return (k, used + t, n + 1), (k,)

    return folded(df, keys, order, [tokens], [T.StructField("batch", T.LongType())], lambda: (0, 0, 0), step)


def extremes(df: DataFrame, value: str, ties: list[str], k: int) -> DataFrame:
    """df's k rows of the highest values and of the lowest, with side."""
    tie = [F.asc(c) for c in ties]
    top, low = df.orderBy(F.desc(value), *tie).limit(k), df.orderBy(F.asc(value), *tie).limit(k)
    return top.withColumn("side", F.lit("top")).unionByName(low.withColumn("side", F.lit("bottom")))


def affinity_stats(df: DataFrame, least: int = 5, least_confirmed: int = 3) -> DataFrame:
    """One row on affinities (n, confirmed, affinity): pairs, confident ones, mean (0.5 without any), above 0.8 and under 0.3."""
    a = F.col("affinity")
    sure = (F.col("n") >= least) & ((F.col("confirmed") >= least_confirmed) | (a < 0.5))
    return df.agg(F.count("*").alias("pairs"), F.count_if(sure).alias("confident"), F.round(F.coalesce(F.avg(a), F.lit(0.5)), 6).alias("mean"), F.count_if(a > 0.8).alias("high"), F.count_if(a < 0.3).alias("low"))


def misjudged(df: DataFrame, score: Column, ok: Column, high: float = 0.7, low: float = 0.5) -> DataFrame:
    """One row: confident scores that were wrong, and unsure ones that were right."""
    return df.agg(F.count("*").alias("n"), F.count_if((score >= high) & ~ok).alias("over_confident"), F.count_if((score < low) & ok).alias("under_confident"))


def performance(df: DataFrame, score: Column, confirmed: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, rate, f1, avg_confirmed, avg_rejected): precision and recall are both the rate of confirmed ones, so F1 is too."""
    side = lambda c: F.coalesce(F.avg(F.when(c, score)), F.lit(0.0))
    rate = F.count_if(confirmed) / F.count("*")
    return df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), rate.alias("rate"), F.when(rate > 0, 2 * rate * rate / (rate + rate)).otherwise(0.0).alias("f1"), side(confirmed).alias("avg_confirmed"), side(~confirmed).alias("avg_rejected"))


def should_apply(old: Column, new: Column, drop: float = 0.05) -> Column:
    """New weights (structs of performance()) are applied if they tell confirmed from rejected better and the rate falls by `drop` at most."""
    apart = lambda m: m["avg_confirmed"] - m["avg_rejected"]
    return (apart(new) > apart(old)) & (new["rate"] >= old["rate"] - drop)


def arm_of(user: Column, test: str, share: float = 0.5) -> Column:
    """The arm of a user in a test, by 48 bits of a hash of both."""
    bits = F.conv(F.substring(F.md5(F.concat(user.cast("string"), F.lit(f":{test}")).cast("binary")), 1, 12), 16, 10).cast("double")
    return F.when(bits / float(16**12) < share, "test").otherwise("control")


def test_decision(control: Column, test: Column, least: int = 100, worse: float = 1.2, better: float = 5.0, significance: float = 0.05) -> Column:
    """Rollback, Promote or Continue, from structs (n, confirmed, rejected) of both arms."""
    t = two_proportions(control["confirmed"], control["n"], test["confirmed"], test["n"])
    rate = lambda a, k: F.when(a["n"] > 0, a[k] / a["n"]).otherwise(0.0)
    more = F.when(rate(control, "rejected") > 0, rate(test, "rejected") / rate(control, "rejected"))
    uplift = F.when(rate(control, "confirmed") > 0, (rate(test, "confirmed") / rate(control, "confirmed") - 1) * 100).otherwise(0.0)
    return F.when(control["n"] + test["n"] < least, "Continue").when((more > worse) & (t["p"] < significance), "Rollback").when((uplift >= better) & (t["p"] < significance), "Promote").otherwise("Continue")
