"""Reports on the driver tables: volumes, bands, quality, integrity, duplicates, staleness, enrichment, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import scoring as Z
from linkloom.operators import quality as Q
from linkloom.operators import relational as R
from linkloom.plans.registry import Tables, query
from linkloom.sources import tables as S

NOW = "1998-12-01"
BAND = "CASE WHEN s >= 0.9 THEN 'Auto' WHEN s >= 0.7 THEN 'Suggest' WHEN s >= 0.5 THEN 'Review' ELSE 'None' END"


def scored(t: Tables) -> DataFrame:
    """Lineitems as matches: a score, an outcome."""
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("s"), F.col("l_returnflag").alias("outcome"))


SCORED = "(SELECT l_orderkey, l_linenumber, l_quantity / 50 AS s, l_returnflag AS outcome FROM lineitem)"


@query(f"SELECT {BAND} AS band, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct, count(*) FILTER (outcome = 'R') AS confirmed, count(*) FILTER (outcome = 'N') AS pending, round(avg(s), 4) AS mean FROM {SCORED} GROUP BY 1")
def score_band_distribution(t):
    g = scored(t).groupBy(Z.band(F.col("s")).alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "R").alias("confirmed"), F.count_if(F.col("outcome") == "N").alias("pending"), F.round(F.avg("s"), 4).alias("mean"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # at most four rows


@query(f"SELECT outcome, count(*) AS n, round(avg(s), 4) AS mean, round(min(s), 4) AS low, round(max(s), 4) AS high, round(stddev_samp(s), 4) AS deviation FROM {SCORED} GROUP BY 1")
def outcome_stats(t):
    return scored(t).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("s"), 4).alias("mean"), F.round(F.min("s"), 4).alias("low"), F.round(F.max("s"), 4).alias("high"), F.round(F.stddev_samp("s"), 4).alias("deviation"))


@query(f"SELECT {BAND} AS band, count(*) FILTER (outcome = 'R') AS confirmed, count(*) FILTER (outcome = 'A') AS rejected, round(100.0 * count(*) FILTER (outcome = 'R') / count(*), 2) AS rate, round(avg(CASE WHEN outcome = 'R' THEN s END), 4) AS mean_confirmed FROM {SCORED} WHERE outcome IN ('R', 'A') GROUP BY 1")
def accuracy_by_tier(t):
    d = scored(t).filter(F.col("outcome").isin("R", "A"))
    hit = F.count_if(F.col("outcome") == "R")
    return d.groupBy(Z.band(F.col("s")).alias("band")).agg(hit.alias("confirmed"), F.count_if(F.col("outcome") == "A").alias("rejected"), F.round(100.0 * hit / F.count("*"), 2).alias("rate"), F.round(F.avg(F.when(F.col("outcome") == "R", F.col("s"))), 4).alias("mean_confirmed"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def ts_daily_volume(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.countDistinct("user_id").alias("users"))


@query("SELECT CAST(ts AS DATE) AS day, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS processed, sum(CASE WHEN value IS NULL OR value < 10 THEN 1 ELSE 0 END)::BIGINT AS low, round(100.0 * sum(CASE WHEN value < 10 THEN 1 ELSE 0 END) / count(*), 2) AS low_pct FROM events GROUP BY 1")
def ts_processing_rate(t):
    low = F.count_if(F.col("value") < 10)
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") != "error").alias("processed"), F.count_if(F.col("value").isNull() | (F.col("value") < 10)).alias("low"), F.round(100.0 * low / F.count("*"), 2).alias("low_pct"))


@query("SELECT hour, n, round(20.0 * n / max(n) OVER (), 0)::INT AS bar FROM (SELECT hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1)")
def ts_hourly_activity(t):
    g = t.events.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return g.withColumn("bar", F.round(20.0 * F.col("n") / F.max("n").over(Window.partitionBy()), 0).cast("int"))  # 24 rows


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(count(*) / 86400.0, 8) AS rate FROM events GROUP BY 1, 2")
def windowed_rate(t):
    g = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("day"), "event_type", "n", F.round(F.col("n") / 86400.0, 8).alias("rate"))


def _null_sql() -> str:
    cols = [("orders", c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")] + [("events", c) for c in ("event_id", "ts", "user_id", "event_type", "value", "props")]
    return " UNION ALL ".join(f"SELECT '{a}' AS table_name, '{c}' AS column_name, count(*) AS total, count(*) - count({c}) AS nulls, round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct, CASE WHEN count(*) = count({c}) THEN 'No Nulls' ELSE 'Review' END AS verdict FROM {a}" for a, c in cols)


@query(_null_sql())
def null_profile(t):
    return Q.null_profile(t.orders, "orders").unionByName(Q.null_profile(t.events, "events"))


@query("SELECT 'events' AS table_name, c AS column_name, total, e AS empty_count FROM (SELECT 'event_type' AS c, count(*) AS total, count(*) FILTER (event_type IS NULL OR event_type = '') AS e FROM events UNION ALL SELECT 'props', count(*), count(*) FILTER (props IS NULL OR props = '') FROM events)")
def empty_string_profile(t):
    return Q.empty_profile(t.events, "events", ["event_type", "props"])


@query("SELECT count(*) AS total, round(min(l_discount), 4) + 0.0 AS low, round(max(l_discount), 4) AS high, round(avg(l_discount), 4) AS mean, count(*) FILTER (l_discount < 0.02 OR l_discount > 0.08) AS out_of_range FROM lineitem")
def range_profile(t):
    return Q.range_profile(t.lineitem.withColumn("l_discount", F.col("l_discount") + 0.0), "l_discount", 0.02, 0.08)


@query("SELECT 'orders' AS table_name, date_diff('day', max(o_orderdate)::DATE, DATE '1998-12-01') AS age_days FROM orders UNION ALL SELECT 'lineitem', date_diff('day', max(l_shipdate)::DATE, DATE '1998-12-01') FROM lineitem UNION ALL SELECT 'events', date_diff('day', max(ts)::DATE, DATE '1998-12-01') FROM events")
def freshness(t):
    return Q.freshness(t.orders, "o_orderdate", "orders", NOW).unionByName(Q.freshness(t.lineitem, "l_shipdate", "lineitem", NOW)).unionByName(Q.freshness(t.events, "ts", "events", NOW))


@query("SELECT 'lines without order' AS rule, count(*) AS refs, count(*) FILTER (o.k IS NULL) AS orphans, round(100.0 * count(*) FILTER (o.k IS NULL) / count(*), 2) AS orphan_pct FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P') o ON o.k = l_orderkey UNION ALL SELECT 'orders without customer', count(*), count(*) FILTER (c.c_custkey IS NULL), round(100.0 * count(*) FILTER (c.c_custkey IS NULL) / count(*), 2) FROM orders LEFT JOIN customer c ON c_custkey = o_custkey")
def fk_orphans(t):
    return Q.orphans(t.lineitem, "l_orderkey", t.orders.filter("o_orderstatus <> 'P'"), "o_orderkey", "lines without order").unionByName(Q.orphans(t.orders, "o_custkey", t.customer, "c_custkey", "orders without customer"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def double_anti(t):
    for s in ("F", "P"):
        keys = t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
        out = (t.customer.select("c_custkey") if s == "F" else out).join(keys, "c_custkey", "left_anti")
    return out


@query("SELECT p_partkey, p_name FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_name = a.p_name AND b.p_brand = a.p_brand AND b.p_partkey <> a.p_partkey)")
def exists_self_dup(t):
    keys = t.part.groupBy("p_name", "p_brand").agg(F.count("*").alias("n")).filter("n > 1")
    return t.part.join(keys, ["p_name", "p_brand"], "left_semi").select("p_partkey", "p_name")


@query("""SELECT *, violations = 0 AS passed FROM (
    SELECT 'score in range' AS rule, 'high' AS severity, count(*) FILTER (l_quantity < 1 OR l_quantity > 49) AS violations FROM lineitem
    UNION ALL SELECT 'price not negative', 'high', count(*) FILTER (p_retailprice < 0) FROM part
    UNION ALL SELECT 'name not empty', 'medium', count(*) FILTER (p_name IS NULL OR p_name = '') FROM part
    UNION ALL SELECT 'order has lines', 'medium', (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
    UNION ALL SELECT 'status known', 'low', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
    UNION ALL SELECT 'discount in range', 'high', count(*) FILTER (l_discount < 0 OR l_discount > 0.09) FROM lineitem
    UNION ALL SELECT 'line has part', 'high', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 49))
    UNION ALL SELECT 'date not ahead', 'medium', count(*) FILTER (o_orderdate > TIMESTAMP '1998-10-01') FROM orders
    UNION ALL SELECT 'customer has nation', 'medium', (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4))
    UNION ALL SELECT 'balances positive', 'low', (SELECT count(*) FROM customer WHERE c_acctbal < 0) + (SELECT count(*) FROM supplier WHERE s_acctbal < 0))""")
def business_rules(t):
    count = lambda df, cond: df.agg(F.count_if(cond))
    lost = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").agg(F.count("*"))
    poor = t.customer.filter("c_acctbal < 0").select("c_custkey").union(t.supplier.filter("s_acctbal < 0").select("s_suppkey")).agg(F.count("*"))
    return Q.rules([
        ("score in range", "high", count(t.lineitem, (F.col("l_quantity") < 1) | (F.col("l_quantity") > 49))),
        ("price not negative", "high", count(t.part, F.col("p_retailprice") < 0)),
        ("name not empty", "medium", count(t.part, F.col("p_name").isNull() | (F.col("p_name") == ""))),
        ("order has lines", "medium", lost),
        ("status known", "low", count(t.orders, ~F.col("o_orderstatus").isin("F", "O"))),
        ("discount in range", "high", count(t.lineitem, (F.col("l_discount") < 0) | (F.col("l_discount") > 0.09))),
        ("line has part", "high", t.lineitem.join(t.part.filter("p_size < 49").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").agg(F.count("*"))),
        ("date not ahead", "medium", count(t.orders, F.col("o_orderdate") > F.lit("1998-10-01").cast("timestamp_ntz"))),
        ("customer has nation", "medium", t.customer.join(t.nation.filter("n_regionkey < 4").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_anti").agg(F.count("*"))),
        ("balances positive", "low", poor),
    ])


@query("SELECT 'part name and brand' AS check_name, count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM (SELECT count(*) AS n FROM part GROUP BY p_name, p_brand HAVING count(*) > 1) UNION ALL SELECT 'orders of a day', count(*), coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate::DATE HAVING count(*) > 1)" + "".join(f" UNION ALL SELECT '{n}', count(*), coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM {k} HAVING count(*) > 1)" for n, k in (("events of a minute", "events GROUP BY user_id, event_type, date_trunc('minute', ts)"), ("parts of an order", "lineitem GROUP BY l_orderkey, l_partkey"), ("texts", "documents GROUP BY text"), ("customer names", "customer GROUP BY c_name"))))
def duplicate_checks(t):
    days = t.orders.withColumn("day", F.to_date("o_orderdate"))
    minutes = t.events.withColumn("minute", F.date_trunc("minute", F.col("ts").cast("timestamp")))
    texts = t.documents.select(F.sha2(F.col("text").cast("binary"), 256).alias("text"))
    checks = [(t.part, ["p_name", "p_brand"], "part name and brand"), (days, ["o_custkey", "day"], "orders of a day"), (minutes, ["user_id", "event_type", "minute"], "events of a minute"), (t.lineitem, ["l_orderkey", "l_partkey"], "parts of an order"), (texts, ["text"], "texts"), (t.customer, ["c_name"], "customer names")]
    return reduce(DataFrame.unionByName, [Q.duplicate_groups(*c) for c in checks])


@query("SELECT count(*) AS total, count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, lower(event_type) FROM events)) AS duplicates, (SELECT count(*) FROM (SELECT DISTINCT user_id, lower(event_type) FROM events)) AS pairs FROM events")
def dup_summary(t):
    pairs = F.count_distinct(F.struct("user_id", F.lower("event_type")))
    return t.events.agg(F.count("*").alias("total"), (F.count("*") - pairs).alias("duplicates"), pairs.alias("pairs"))


@query("SELECT p_name, count(*) AS n, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def dup_crosspost(t):
    g = t.part.groupBy("p_name").agg(F.count("*").alias("n"), F.collect_set("p_brand").alias("b"))  # brands are few
    return g.filter(F.size("b") > 1).select("p_name", "n", F.array_join(F.array_sort("b"), ", ").alias("brands"), F.size("b").cast("long").alias("n_brands"))


@query("SELECT CASE WHEN span < 60 THEN 'hour' WHEN span < 1440 THEN 'day' ELSE 'more' END AS bucket, count(*) AS groups, round(avg(span), 1) AS mean_minutes FROM (SELECT user_id, event_type, round((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 60.0, 1) AS span FROM events GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def dup_time_windows(t):
    sec = lambda c: F.unix_timestamp(c.cast("timestamp"))
    g = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round((sec(F.max("ts")) - sec(F.min("ts"))) / 60.0, 1).alias("span")).filter("n > 1")
    bucket = F.when(F.col("span") < 60, "hour").when(F.col("span") < 1440, "day").otherwise("more")
    return g.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("groups"), F.round(F.avg("span"), 1).alias("mean_minutes"))


@query("SELECT event_id, user_id, rn, rn > 1 AS duplicate FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(event_type), CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events)")
def dedup_keep_oldest(t):
    return R.mark_duplicates(t.events, [F.col("user_id"), F.lower("event_type"), F.to_date("ts")], [F.asc("ts"), F.asc("event_id")]).select("event_id", "user_id", "rn", "duplicate")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def keep_first_by_key(t):
    first = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("m"))
    return first.select("user_id", "event_type", F.col("m.event_id").alias("event_id"))


@query("SELECT a.event_id AS event_id, count(*) AS earlier FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 10 MINUTE GROUP BY 1")
def time_bounded_repeats(t):
    # microseconds, so that a range frame says what the self-join says
    e = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id", "event_type").orderBy("us").rangeBetween(-600_000_000, -1)
    return e.select("event_id", F.count("*").over(w).alias("earlier")).filter("earlier > 0")


@query("SELECT name, kind, count(*) AS n FROM (SELECT lower(p_name) AS name, 'part' AS kind FROM part UNION ALL SELECT lower(p_type), 'type' FROM part) GROUP BY 1, 2 ORDER BY n DESC, name, kind LIMIT 15")
def top_names_union(t):
    u = t.part.select(F.lower("p_name").alias("name"), F.lit("part").alias("kind")).unionByName(t.part.select(F.lower("p_type").alias("name"), F.lit("type").alias("kind")))
    return u.groupBy("name", "kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name", "kind").limit(15)


@query("SELECT bucket, CASE bucket WHEN '0-30' THEN 1 WHEN '31-180' THEN 2 WHEN '181-365' THEN 3 ELSE 4 END AS sort_order, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, CASE WHEN d <= 30 THEN '0-30' WHEN d <= 180 THEN '31-180' WHEN d <= 365 THEN '181-365' ELSE '365+' END AS bucket FROM (SELECT o_totalprice, date_diff('day', o_orderdate::DATE, DATE '1998-12-01') AS d FROM orders WHERE o_orderstatus = 'P')) GROUP BY 1, 2")
def stale_age_buckets(t):
    d = F.datediff(F.lit(NOW).cast("date"), F.col("o_orderdate").cast("date"))
    k = F.when(d <= 30, 1).when(d <= 180, 2).when(d <= 365, 3).otherwise(4)
    g = t.orders.filter("o_orderstatus = 'P'").groupBy(k.alias("sort_order")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.withColumn("bucket", F.element_at(F.array(*map(F.lit, ("0-30", "31-180", "181-365", "365+"))), F.col("sort_order")))


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-06-01' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def stale_samples(t):
    old = t.orders.filter("o_orderstatus = 'P' AND o_orderdate < timestamp_ntz '1998-06-01'")
    first = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return old.join(first, "o_orderkey").join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT l_orderkey, l_linenumber, coalesce(c_name, 'Unknown') AS customer, coalesce(cn.n_name, 'Unknown') AS customer_nation, s_name, r_name AS supplier_region, coalesce(p_name, '-') AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = sn.n_regionkey LEFT JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'")
def match_enrich(t):
    # nations and regions are fixed lists; the other sides are left to the optimiser
    cn = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cn"))
    sn = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("s_nationkey"), "r_name")
    out = t.lineitem.filter("l_returnflag = 'R'").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.join(t.customer.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").join(cn, "c_nationkey", "left")
    out = out.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(sn, "s_nationkey", "left").join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return out.select("l_orderkey", "l_linenumber", F.coalesce("c_name", F.lit("Unknown")).alias("customer"), F.coalesce("cn", F.lit("Unknown")).alias("customer_nation"), "s_name", F.col("r_name").alias("supplier_region"), F.coalesce("p_name", F.lit("-")).alias("part"))


@query("SELECT c_custkey, count(o_orderkey) AS orders, count(*) FILTER (o_orderstatus = 'F') AS confirmed, count(*) FILTER (o_orderstatus = 'O') AS rejected, round(CASE WHEN count(*) FILTER (o_orderstatus IN ('F', 'O')) = 0 THEN 0 ELSE 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus IN ('F', 'O')) END, 2) AS approval_pct, max(o_orderdate)::DATE AS last_activity FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def participant_stats(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("confirmed"), F.count_if(F.col("o_orderstatus") == "O").alias("rejected"), F.max("o_orderdate").cast("date").alias("last_activity"))
    j = t.customer.select("c_custkey").join(o, "c_custkey", "left").fillna(0, ["orders", "confirmed", "rejected"])
    return j.withColumn("approval_pct", Q.percent(F.col("confirmed"), F.col("confirmed") + F.col("rejected")))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def common_groups(t):
    a = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("n_nationkey"))
    b = t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return t.nation.join(a, "n_nationkey", "left_semi").join(b, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def disjunctive_match(t):
    # two equi joins with distinct keys and a filter on their hits: rows that repeat stay, and nothing is a nested loop
    a = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("a")).distinct()
    b = t.part.filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("b")).distinct()
    both = t.lineitem.join(a, "l_suppkey", "left").join(b, "l_partkey", "left")
    return both.filter(F.coalesce("a", "b", F.lit(False))).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND (o_totalprice > 100000 OR o_orderstatus = 'P') AND NOT starts_with(o_orderpriority, '1') AND contains(lower(o_orderpriority), 'o') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10")
def dynamic_filter_page(t):
    c = F.col
    cond = R.all_of([c("o_orderdate") <= F.lit("1996-01-01").cast("timestamp_ntz"), (c("o_totalprice") > 100000) | (c("o_orderstatus") == "P"), None, ~c("o_orderpriority").startswith("1"), F.lower("o_orderpriority").contains("o")])
    return R.page(t.orders.filter(cond), [F.desc_nulls_first("o_orderdate"), F.asc("o_orderkey")], 50, 10).select("o_orderkey", "o_orderpriority")


@query("SELECT event_id FROM events WHERE (hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 360) AND event_type IN ('click', 'view') AND value BETWEEN 5 AND 50")
def schedule_filter(t):
    m = F.hour("ts") * 60 + F.minute("ts")
    return t.events.filter(((m >= 1320) | (m < 360)) & F.col("event_type").isin("click", "view") & F.col("value").between(5, 50)).select("event_id")


@query("SELECT event_type, count(*) AS n, round(min(v), 4) AS low, round(max(v), 4) AS high, round(avg(v), 6) AS mean, floor(quantile_cont(v, 0.5))::BIGINT AS median, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, round(stddev_pop(v), 6) AS deviation FROM (SELECT event_type, floor(value * 10)::BIGINT AS v FROM events) GROUP BY 1")
def latency_stats(t):
    return Q.latency(t.events.select("event_type", F.floor(F.col("value") * 10).cast("long").alias("v")), ["event_type"], "v")


@query("SELECT event_type, list_sort(list(value))[1 + round((count(*) - 1) * 0.95)::INT] AS p95 FROM events GROUP BY 1")
def percentile_rank_variant(t):
    return Q.ranked_values(t.events, ["event_type"], "value", {"p95": 0.95})


@query("SELECT event_type, p95, threshold FROM (SELECT event_type, quantile_disc(value * 10, 0.95) AS p95, CASE event_type WHEN 'click' THEN 50 WHEN 'view' THEN 100000 ELSE 100 END AS threshold FROM events GROUP BY 1) WHERE p95 > threshold")
def slow_stage_alerts(t):
    p = t.events.withColumn("v", F.col("value") * 10).groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("p95"))
    return p.withColumn("threshold", F.when(F.col("event_type") == "click", 50).when(F.col("event_type") == "view", 100000).otherwise(100)).filter("p95 > threshold")


@query("SELECT * FROM (SELECT 'P' AS s, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderstatus = 'O') AS rejected, 0::BIGINT AS skipped FROM orders)")
def review_status_counts(t):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return t.orders.agg(n("P").alias("pending"), n("F").alias("approved"), n("O").alias("rejected"), n("S").alias("skipped")).withColumn("s", F.lit("P"))


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM (SELECT c_nationkey, c_custkey, c_acctbal FROM customer)) WHERE rank <= 3")
def top_k_per_group(t):
    return R.top_k(t.customer.select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderdate < TIMESTAMP '1998-12-01' - INTERVAL 1000 DAY AND o_orderstatus = 'F')")
def retention_keep(t):
    return R.retained(t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), "o_orderdate", NOW, 1000, F.col("o_orderstatus") == "F").select("o_orderkey")


@query("WITH a AS (SELECT lower(p_name) AS alias, count(*) AS n, min(p_partkey) AS f, max(p_partkey) AS l FROM part WHERE p_size <= 20 GROUP BY 1), b AS (SELECT lower(p_name) AS alias, count(*) AS n, min(p_partkey) AS f, max(p_partkey) AS l FROM part WHERE p_size > 10 GROUP BY 1) SELECT coalesce(a.alias, b.alias) AS alias, coalesce(b.n, a.n) AS occurrences, coalesce(a.f, b.f) AS first_seen, coalesce(b.l, a.l) AS last_seen FROM a FULL JOIN b ON a.alias = b.alias")
def upsert_aliases(t):
    side = lambda cond: t.part.filter(cond).groupBy(F.lower("p_name").alias("alias")).agg(F.count("*").alias("occurrences"), F.min("p_partkey").alias("first_seen"), F.max("p_partkey").alias("last_seen"))
    return R.upsert_counts(side("p_size <= 20"), side("p_size > 10"), "alias")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 'EXPIRED' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def status_transition(t):
    old = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return R.set_status(t.orders, old, "EXPIRED", "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NOT NULL AND l_linestatus = 'O' THEN 'EXPIRED' ELSE l_linestatus END AS status FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') ON o_orderkey = l_orderkey")
def cascade_cancel(t):
    gone = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("gone"))
    return t.lineitem.join(gone, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.when(F.col("gone") & (F.col("l_linestatus") == "O"), "EXPIRED").otherwise(F.col("l_linestatus")).alias("status"))


@query("SELECT o_custkey, o_totalprice, 'new' AS origin FROM (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def insert_ignore(t):
    new = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    there = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return new.join(there, "o_custkey", "left_anti").withColumn("origin", F.lit("new"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in S.NAMES))
def table_counts(t):
    return S.counts_of(t.spark, t.sf_dir)


@query("SELECT doc_id, prefix, n FROM (SELECT event_id AS doc_id, json_extract_string(props, '$.k')::BIGINT AS n, 'k' AS prefix FROM events)")
def json_extract(t):
    return t.events.select(F.col("event_id").alias("doc_id"), F.get_json_object("props", "$.k").cast("long").alias("n"), F.lit("k").alias("prefix"))
