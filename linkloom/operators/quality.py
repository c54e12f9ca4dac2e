"""Profiles of tables: nulls, empties, ranges, duplicates, orphans, freshness, time series. One pass over each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.when(whole == 0, 0.0).otherwise(100.0 * part / whole), digits)


def null_profile(df: DataFrame, name: str, expected: list[str] | None = None) -> DataFrame:
    """(table_name, column_name, total, nulls, null_pct, verdict): a row per column, from one scan; columns in `expected` may have nulls."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = one.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])).alias("x")).select(F.lit(name).alias("table_name"), "x.column_name", "total", "x.nulls")
    pct = percent(F.col("nulls"), F.col("total"))
    verdict = F.when(F.col("column_name").isin(*(expected or [])), "Expected").when(F.col("nulls") == 0, "No Nulls").when(pct > 50, "High").otherwise("Review")
    return rows.withColumn("null_pct", pct).withColumn("verdict", verdict)


def empty_profile(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(table_name, column_name, total, empty_count): null or empty strings."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull() | (F.col(c) == "")).alias(c) for c in columns])
    return one.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("empty_count")) for c in columns])).alias("x")).select(F.lit(name).alias("table_name"), "x.column_name", "total", "x.empty_count")


def range_profile(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    v = F.col(value)
    return df.agg(F.count("*").alias("total"), F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"), F.round(F.avg(v), 4).alias("mean"), F.count_if((v < low) | (v > high)).alias("out_of_range"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """(rule, refs, orphans, orphan_pct): non-null references without a parent; the counts of keys are joined, not the rows."""
    refs = child.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    lost = refs.join(parent.select(F.col(parent_key).alias("k")).distinct().withColumn("hit", F.lit(1)), "k", "left")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("refs"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n")).otherwise(0)), F.lit(0)).alias("orphans")).select(F.lit(name).alias("rule"), "refs", "orphans", percent(F.col("orphans"), F.col("refs")).alias("orphan_pct"))


def duplicate_groups(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(check_name, groups, extra_rows): key groups with more than one row."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows")).select(F.lit(name).alias("check_name"), "groups", "extra_rows")


def freshness(df: DataFrame, at: str, name: str, now: str) -> DataFrame:
    return df.agg(F.max(at).alias("latest")).select(F.lit(name).alias("table_name"), F.datediff(F.lit(now).cast("date"), F.col("latest").cast("date")).cast("long").alias("age_days"))


def rules(checks: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(rule, severity, violations, passed) from (rule, severity, one-row count frame)."""
    parts = [c.toDF("violations").select(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.coalesce(F.col("violations").cast("long"), F.lit(0)).alias("violations")) for r, s, c in checks]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)


def latency(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, extremes, mean, median (whole; an even count gives the mean of the middle two), nearest-rank p95 and p99, population deviation."""
    v = F.col(value)
    ranked = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.floor(F.percentile(v, F.lit(0.5))).cast("long").alias("median"), ranked(0.95).alias("p95"), ranked(0.99).alias("p99"), F.round(F.stddev_pop(v), 6).alias("deviation"))


def completeness(df: DataFrame, name: str, filled: dict[str, Column]) -> DataFrame:
    """(table_name, field, total, filled, pct): how many rows meet each field's condition; null counts as unfilled."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f) for f, c in filled.items()])
    rows = one.select("total", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in filled])).alias("x"))
    return rows.select(F.lit(name).alias("table_name"), "x.field", "total", "x.filled", percent(F.col("x.filled"), F.col("total"), 1).alias("pct"))


def errors(df: DataFrame, message: str, k: int) -> DataFrame:
    """(message, n, total, kinds): the k most frequent messages, beside the count of all and of distinct ones; nulls are no errors."""
    by = df.filter(F.col(message).isNotNull()).groupBy(F.col(message).alias("message")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "message").limit(k).crossJoin(by.agg(F.sum("n").alias("total"), F.count("*").alias("kinds")))  # one row


def retry_counts(df: DataFrame, status: str = "status", reason: str = "reason") -> DataFrame:
    """One row: how many are in each status, and for each of the three reasons that are retried."""
    s, r = F.col(status), F.col(reason)
    reasons = {"circuit_breaker": "CircuitBreaker", "network_error": "NetworkError", "incomplete_json": "IncompleteJson"}
    return df.agg(*[F.count_if(s == x).alias(x.lower()) for x in ("PENDING", "PROCESSING", "COMPLETED", "FAILED")], *[F.count_if(r == x).alias(n) for n, x in reasons.items()])


def wait_split(ms: Column) -> Column:
    """struct(queue, processing): a tenth of the time, whole, is waiting."""
    queue = F.floor(ms / 10).cast("long")
    return F.struct(queue.alias("queue"), (ms - queue).alias("processing"))


def approvals(df: DataFrame, action: str, confidence: str, overridden: str) -> DataFrame:
    """One row: counts by action, the mean confidence of what was approved, and overrides among it."""
    yes = F.col(action) == "Approved"
    n = F.count_if(yes)
    return df.agg(
        n.alias("approved"), F.count_if(F.col(action) == "Queued").alias("queued"), F.count_if(F.col(action) == "Blocked").alias("blocked"),
        F.round(F.coalesce(F.avg(F.when(yes, F.col(confidence))), F.lit(0.0)), 6).alias("mean_confidence"), F.round(F.when(n == 0, 0.0).otherwise(F.count_if(yes & F.col(overridden)) / n), 6).alias("override_rate"),
    )


def recent_processing(df: DataFrame, keys: list[str], order: list[str], ms: str, last: int) -> DataFrame:
    """(keys, n, mean_ms, p95, per_second): mean and nearest-rank p95 of the last rows of each key, and its rows a second of processing."""
    recent = df.withColumn("r__", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter(F.col("r__") <= last)
    late = recent.groupBy(*keys).agg(F.round(F.avg(ms), 6).alias("mean_ms"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{ms}`)").alias("p95"))
    total = F.sum(ms)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.when(total == 0, 0.0).otherwise(F.count("*") / total * 1000), 6).alias("per_second")).join(late, keys)


def strategies(df: DataFrame, scores: dict[str, Column], high: float = 0.85, low: float = 0.5) -> DataFrame:
    """(strategy, n, mean, high, low) of each strategy's scores, from one scan."""
    parts = [f(c).alias(f"{k}{i}") for k, c in scores.items() for i, f in enumerate((F.count, F.avg, lambda x: F.count_if(x >= high), lambda x: F.count_if(x < low)))]
    rows = [F.struct(F.lit(k).alias("strategy"), F.col(f"{k}0").alias("n"), F.round(F.col(f"{k}1"), 6).alias("mean"), F.col(f"{k}2").alias("high"), F.col(f"{k}3").alias("low")) for k in scores]
    return df.agg(*parts).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def reduction(df: DataFrame, kept: Column, hit: Column) -> DataFrame:
    """One row: candidates before and after a filter, the share it takes away, and the hits of a cache in percent."""
    n, m = F.count("*"), F.count_if(kept)
    return df.agg(n.alias("candidates_in"), m.alias("candidates_out"), F.round(F.when(n == 0, 0.0).otherwise(1 - m / n), 6).alias("reduction"), percent(F.count_if(hit), n).alias("hit_rate"))


def ranked_values(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], buckets: int = 4096) -> DataFrame:
    """(keys, a column for each share p): the value at the index round((n - 1) p) of the key's sorted values.

    By two histograms of partial counts: equal buckets between a key's extremes, then the distinct values of the bucket
    that holds the index; a key is never sorted whole. Nulls don't count.
    """
    v = F.col(value)
    rows = df.filter(v.isNotNull()).select(*keys, v.alias("v__"))
    ends = rows.groupBy(*keys).agg(F.min("v__").alias("low__"), F.max("v__").alias("high__"), F.count("*").alias("n__"))
    at = F.when(F.col("high__") > F.col("low__"), F.least(F.lit(buckets - 1), F.floor((F.col("v__") - F.col("low__")) / (F.col("high__") - F.col("low__")) * buckets).cast("int"))).otherwise(0)
    placed = rows.join(ends, keys).withColumn("b__", at)
    upto = Window.partitionBy(*keys).orderBy("b__")
    bins = placed.groupBy(*keys, "b__", "n__").agg(F.count("*").alias("c__")).withColumn("upto__", F.sum("c__").over(upto))
    out = None
    for name, p in shares.items():
        index = F.round((F.col("n__") - 1) * p).cast("long")
        mine = bins.filter((index < F.col("upto__")) & (index >= F.col("upto__") - F.col("c__"))).select(*keys, "b__", (index - F.col("upto__") + F.col("c__")).alias("left__"))
        values = placed.join(mine, [*keys, "b__"]).groupBy(*keys, "v__", "left__").agg(F.count("*").alias("c__")).withColumn("upto__", F.sum("c__").over(Window.partitionBy(*keys).orderBy("v__")))
        one = values.filter((F.col("left__") < F.col("upto__")) & (F.col("left__") >= F.col("upto__") - F.col("c__"))).select(*keys, F.col("v__").alias(name))
        out = one if out is None else out.join(one, keys)
    return out


def model_quality(df: DataFrame, model: str, ok: str, filled: dict[str, Column], confidence: Column, ms: str) -> DataFrame:
    """(model, n, success, a percentage for each of the three fields, buckets, p50, p95, quality) of each model's answers.

    buckets: good answers by confidence in fifths. quality: weighted, from success, the fields, confidence and how far the
    mean time stays under ten seconds.
    """
    good = F.col(ok)
    share = lambda c: F.when(F.count_if(good) == 0, 0.0).otherwise(100.0 * F.count_if(good & c) / F.count_if(good))
    edges = [0.0, 0.2, 0.4, 0.6, 0.8, 1e9]
    g = df.groupBy(model).agg(
        F.count("*").alias("n"), (100.0 * F.count_if(good) / F.count("*")).alias("success"), *[share(c).alias(k) for k, c in filled.items()],
        F.array(*[F.count_if(good & (confidence >= a) & (confidence < b)) for a, b in zip(edges, edges[1:], strict=False)]).alias("buckets"),
        F.coalesce(F.avg(F.when(good, confidence)), F.lit(0.0)).alias("confidence__"), F.avg(ms).alias("ms__"),
    )
    first, second, third = (F.col(k) for k in filled)
    quality = 0.25 * F.col("success") + 0.25 * first + 0.15 * second + 0.15 * third + 15 * F.col("confidence__") + 0.05 * F.greatest(10000 - F.floor("ms__"), F.lit(0)) / 100
    return g.withColumn("quality", quality).drop("confidence__", "ms__").join(ranked_values(df, [model], ms, {"p50": 0.5, "p95": 0.95}), model)


def histogram_quantile(q: float, n: Column, counts: list[Column], bounds: tuple[float, ...]) -> Column:
    """The quantile of a histogram of cumulative counts (values up to each bound), linear within its bucket; beyond the last bound that bound."""
    out, low, before = None, 0.0, F.lit(0)
    for c, b in zip(counts, bounds, strict=True):
        value = F.lit(low) + (b - low) * (q * n - before) / (c - before)
        out = F.when(c >= q * n, value) if out is None else out.when(c >= q * n, value)
        low, before = b, c
    return out.otherwise(F.lit(bounds[-1]))


def observed(df: DataFrame, name: str, metrics: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """df, and its metrics, which are counted as it is written or read anyway; their values are there after the first action."""
    o = Observation(name)
    return df.observe(o, *[c.alias(k) for k, c in metrics.items()]), o
