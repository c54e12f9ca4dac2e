"""Joins, deduplication, paging and table rewrites as DataFrame -> DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(conditions: list[Column | None]) -> Column:
    """The conjunction of the filters that are given; true without any."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def sort_by(column: str, direction: str, allowed: list[str], tie: str) -> list[Column]:
    """A requested order, nulls first where it falls; anything but the allowed columns and asc or desc is refused."""
    if column not in allowed or direction not in ("asc", "desc"):
        raise ValueError(f"{column} {direction}")
    return [F.desc_nulls_first(column) if direction == "desc" else F.asc_nulls_last(column), F.asc(tie)]


def most_recent(df: DataFrame, at: str, tie: str, n: int) -> DataFrame:
    """The n newest rows: what a ring buffer of that size holds of an append-only log."""
    return df.orderBy(F.desc(at), F.desc(tie)).limit(n)


def status_of(processed_at: Column, error: Column) -> Column:
    """Error if there is one, else Processed with a time, else Unprocessed."""
    return F.when(error.isNotNull(), "Error").when(processed_at.isNotNull(), "Processed").otherwise("Unprocessed")


def any_contains(columns: list[str], text: str) -> Column:
    """Whether any of the columns holds the text, in any case."""
    return reduce(lambda a, b: a | b, [F.lower(c).contains(text.lower()) for c in columns])


def audit_filter(df: DataFrame, match_id: object = None, event_type: str | None = None, start: str | None = None, end: str | None = None, min_confidence: float | None = None, max_confidence: float | None = None, overridden: bool | None = None, override_by: object = None) -> DataFrame:
    """Audit entries that meet the filters given; both ends of the times count, and a null confidence meets no bound."""
    at = lambda x: F.lit(x).cast(df.schema["ts"].dataType)
    given = [
        (match_id, lambda: F.col("match_id") == match_id), (event_type, lambda: F.col("event_type") == event_type), (start, lambda: F.col("ts") >= at(start)), (end, lambda: F.col("ts") <= at(end)),
        (min_confidence, lambda: F.col("confidence") >= min_confidence), (max_confidence, lambda: F.col("confidence") <= max_confidence), (overridden, lambda: F.col("overridden") == overridden), (override_by, lambda: F.col("override_by") == override_by),
    ]
    return df.filter(all_of([make() for value, make in given if value is not None]))


def pass_route(confidence: Column) -> Column:
    """Answers under 0.4 go to review, under 0.7 to a second pass."""
    return F.when(confidence < 0.4, "review").when(confidence < 0.7, "second_pass").otherwise("accept")


def auto_confirmed(df: DataFrame, sure: Column, now: str, by: str = "auto") -> tuple[DataFrame, DataFrame]:
    """The pending matches that are sure, confirmed, and a feedback row for each."""
    changed = confirmed(df.filter((F.col("status") == "PENDING") & sure), F.lit(True), "CONFIRMED", now, F.lit(by))
    return changed, changed.drop("status", "confirmed_at", "matched_by").withColumns({"confirmed": F.lit(True), "created_at": F.lit(now).cast("timestamp_ntz")})


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    """Point lookup: the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


def active_at(df: DataFrame, begins: str, ends: str, now: str, active: Column | None = None) -> DataFrame:
    """Rows that are active and valid now: begun, and without an end or not ended yet."""
    at = F.lit(now).cast(df.schema[begins].dataType)
    return df.filter(all_of([active, F.col(begins) <= at, F.col(ends).isNull() | (F.col(ends) > at)]))


def common(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of the second table whose key the first has, in the second's order."""
    return second.join(first.select(key).distinct(), key, "left_semi").withColumn("place", F.row_number().over(Window.orderBy(order)))  # one user's groups


def sync_groups(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """(key, name, members, action) from tables of (key, name, members array): groups after a synchronisation, and what it did to each."""
    t, i = table.select(key, F.col("name").alias("t_name"), F.size("members").alias("t_n")), incoming.select(key, F.col("name").alias("i_name"), F.size(F.array_distinct("members")).alias("i_n"))
    action = F.when(F.col("t_n").isNull(), "added").when(F.col("i_n").isNull(), "kept").otherwise("updated")
    return t.join(i, key, "full_outer").select(key, F.coalesce("i_name", "t_name").alias("name"), F.coalesce("i_n", "t_n").alias("members"), action.alias("action"))


def touched(table: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Save or update: (key, occurrences, first_seen, last_seen) of which rows that were there only get a later last_seen."""
    t, s = table.alias("t"), seen.alias("s")
    return t.join(s, key, "full_outer").select(key, F.coalesce("t.occurrences", "s.occurrences").alias("occurrences"), F.coalesce("t.first_seen", "s.first_seen").alias("first_seen"), F.greatest("t.last_seen", "s.last_seen").alias("last_seen"))


def filled_from(df: DataFrame, column: str, key: Column, lookup: DataFrame) -> DataFrame:
    """Update from a join: nulls of a column are filled from lookup (k, v) by key; what is there stays."""
    one = lookup.groupBy("k").agg(F.min("v").alias("v__"))
    joined = df.withColumn("k__", key).join(one, F.col("k__") == F.col("k"), "left")
    return joined.withColumn(column, F.coalesce(column, "v__")).drop("k", "k__", "v__")


def confirmed(df: DataFrame, where: Column, status: str, now: str, by: Column) -> DataFrame:
    """A decision: status and confirmed_at of the rows that meet `where`, and matched_by unless that is empty."""
    old = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    return df.withColumns({
        "status": F.when(where, status).otherwise(F.col("status")),
        "confirmed_at": F.when(where, F.lit(now).cast("timestamp_ntz")).otherwise(old("confirmed_at", "timestamp_ntz")),
        "matched_by": F.when(where & (F.trim(by) != ""), by).otherwise(old("matched_by", "string")),
    })


def counted(counters: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Counters (key, n) after steps (key, step): their sum, never below 0."""
    steps = changes.groupBy(key).agg(F.sum("step").alias("s__"))
    return counters.join(steps, key, "left").withColumn("n", F.greatest(F.lit(0).cast("long"), F.col("n") + F.coalesce("s__", F.lit(0)))).drop("s__")


def bulk(ids: DataFrame, table: DataFrame, key: str, refused: Column) -> DataFrame:
    """(key, ok, reason) for each distinct id that was asked for: unknown ones and those with a reason to refuse fail, the others succeed."""
    rows = table.select(key, refused.alias("r__"), F.lit(True).alias("t__"))
    reason = F.when(F.col("t__").isNull(), "not found").otherwise(F.col("r__"))
    return ids.select(key).distinct().join(rows, key, "left").select(key, reason.isNull().alias("ok"), reason.alias("reason"))


def undone(df: DataFrame, approved_at: str, now: str, minutes: int = 30) -> DataFrame:
    """df with undone: whether an approval can still be taken back, up to so many minutes later; null without an approval."""
    return df.withColumn("undone", F.lit(now).cast("timestamp") <= F.timestamp_seconds(F.unix_timestamp(F.col(approved_at).cast("timestamp")) + 60 * minutes))


def dequeued(df: DataFrame, now: str, k: int) -> DataFrame:
    """The next k pending items that are due, the highest priority first and the oldest of equals, as PROCESSING."""
    due = df.filter((F.col("status") == "PENDING") & (F.col("next_at") <= F.lit(now).cast("timestamp_ntz")))
    return due.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id")).limit(k).withColumn("status", F.lit("PROCESSING"))


def failed(df: DataFrame, now: str, most: int = 3, delay: int = 60) -> DataFrame:
    """Items after a failure: one attempt more, due again after the delay, FAILED for good at `most`."""
    n = F.col("attempts") + 1
    return df.withColumns({"attempts": n, "status": F.when(n >= most, "FAILED").otherwise("PENDING"), "next_at": F.lit(now).cast("timestamp_ntz") + F.expr(f"interval {delay} seconds")})


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key; a struct minimum instead of a sort where a row fits in one."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def mark_duplicates(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """df with rn and duplicate: all rows of a key but its first."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("duplicate", F.col("rn") > 1)


def either(df: DataFrame, key: str, *sides: DataFrame) -> DataFrame:
    """Rows whose key is in any of the sides: a union of keys and one semi join, never an OR join."""
    keys = reduce(DataFrame.union, [s.select(s.columns[0]).toDF(key) for s in sides]).distinct()
    return df.join(keys, key, "left_semi")


def pair_key(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("pair_a"), F.greatest(a, b).alias("pair_b")]


def probe(pairs: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    """pairs (pair_a, pair_b) with a boolean column: whether the pair is in the list, which has unordered pair keys too."""
    keys = listed.select("pair_a", "pair_b").distinct().withColumn(name, F.lit(True))
    return pairs.join(keys, ["pair_a", "pair_b"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def upsert_counts(table: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Aliases with (occurrences, first_seen, last_seen): counts and last_seen are replaced, first_seen stays."""
    t, s = table.alias("t"), seen.alias("s")
    return t.join(s, key, "full_outer").select(key, F.coalesce("s.occurrences", "t.occurrences").alias("occurrences"), F.coalesce("t.first_seen", "s.first_seen").alias("first_seen"), F.coalesce("s.last_seen", "t.last_seen").alias("last_seen"))


def set_status(df: DataFrame, where: Column, status: str, column: str = "status") -> DataFrame:
    return df.withColumn(column, F.when(where, F.lit(status)).otherwise(F.col(column)))


def retained(df: DataFrame, at: str, now: str, days: int, also: Column | None = None) -> DataFrame:
    """Rows that retention keeps: not older than so many days, or (with `also`) not meeting it."""
    old = F.col(at) < F.expr(f"timestamp '{now}' - interval {days} days")
    return df.filter(~F.coalesce(old & (also if also is not None else F.lit(True)), F.lit(False)))
