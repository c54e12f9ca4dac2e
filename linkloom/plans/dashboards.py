"""Dashboards: completeness, errors, queues, retries, curation, approvals, models, quantiles and windows over outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators import audit as A
from linkloom.operators import learning as L
from linkloom.operators import linkage as K
from linkloom.operators import quality as Q
from linkloom.operators import relational as R
from linkloom.plans.auditing import records
from linkloom.plans.registry import Tables, query

TODAY = "1998-06-15 12:00:00"
#: Lines as matches: who, how sure, decided how and when.
MATCHES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50 AS s, CASE l_returnflag WHEN 'R' THEN 'CONFIRMED' WHEN 'A' THEN 'REJECTED' ELSE 'PENDING' END AS status, l_shipdate AS made FROM lineitem)"


def matches(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 50).alias("s"), F.when(flag == "R", "CONFIRMED").when(flag == "A", "REJECTED").otherwise("PENDING").alias("status"), F.col("l_shipdate").alias("made"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# nulls and completeness; the expressions are the same text in both engines


NULLABLE = {
    "orders": {"o_orderkey": "o_orderkey", "o_orderstatus": "nullif(o_orderstatus, 'P')", "o_orderpriority": "nullif(o_orderpriority, '5-LOW')", "o_totalprice": "o_totalprice"},
    "lineitem": {"l_quantity": "nullif(l_quantity, 1.0)", "l_tax": "CASE WHEN l_tax > 0.06 THEN l_tax END", "l_shipdate": "l_shipdate"},
    "events": {"event_id": "event_id", "value": "CASE WHEN value < 15 THEN value END", "props": "nullif(props, '{\"k\": 1}')"},
    "labels": {"doc_id": "doc_id", "quality": "nullif(quality, 0)", "toxic": "nullif(toxic, 0)"},
    "customer": {"c_name": "c_name", "c_acctbal": "CASE WHEN c_acctbal > 0 THEN c_acctbal END"},
    "part": {"p_name": "p_name", "p_brand": "nullif(p_brand, 'Brand#2')", "p_size": "nullif(p_size, 7)"},
}
EXPECTED = {"events": ["value"], "labels": ["toxic"]}


def _nulls_sql() -> str:
    one = "SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total, count(*) - count({e}) AS nulls, round(100.0 * (count(*) - count({e})) / count(*), 2) AS null_pct, {v} AS verdict FROM {t}"
    verdict = "CASE WHEN count(*) = count({e}) THEN 'No Nulls' WHEN round(100.0 * (count(*) - count({e})) / count(*), 2) > 50 THEN 'High' ELSE 'Review' END"
    return " UNION ALL ".join(one.format(t=t, c=c, e=e, v="'Expected'" if c in EXPECTED.get(t, []) else verdict.format(e=e)) for t, cols in NULLABLE.items() for c, e in cols.items())


@query(_nulls_sql())
def null_profiles(t):
    return union([Q.null_profile(getattr(t, n).select(*[F.expr(e).alias(c) for c, e in cols.items()]), n, EXPECTED.get(n, [])) for n, cols in NULLABLE.items()])


@query(f"SELECT verdict, count(*) AS columns, sum(nulls)::BIGINT AS nulls FROM ({_nulls_sql()}) GROUP BY 1")
def null_summary(t):
    return null_profiles(t).groupBy("verdict").agg(F.count("*").alias("columns"), F.sum("nulls").alias("nulls"))


COMPLETE = {
    "lineitem": {"quantity": "l_quantity > 1", "discount": "l_discount > 0", "flag": "nullif(l_returnflag, 'N') <> ''"},
    "part": {"name": "p_name <> ''", "size": "nullif(p_size, 7) > 0", "price": "p_retailprice > 950"},
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{f}' AS field, count(*) AS total, count(*) FILTER ({e}) AS filled, round(100.0 * count(*) FILTER ({e}) / count(*), 1) AS pct FROM {t}" for t, fs in COMPLETE.items() for f, e in fs.items()))
def completeness_rates(t):
    return union([Q.completeness(getattr(t, n), n, {f: F.expr(e) for f, e in fs.items()}) for n, fs in COMPLETE.items()])


# errors, queues, retries, curation


@query("WITH e AS (SELECT props FROM events WHERE event_type = 'error') SELECT props AS message, count(*) AS n, (SELECT count(*) FROM e) AS total, (SELECT count(DISTINCT props) FROM e) AS kinds FROM e GROUP BY 1 ORDER BY n DESC, message LIMIT 5")
def error_profile(t):
    return Q.errors(t.events.filter("event_type = 'error'"), "props", 5)


@query("SELECT o_orderstatus AS status, count(*) AS n, round(avg((o_orderkey % 100) / 100.0::DOUBLE), 4) AS mean_confidence FROM orders GROUP BY 1")
def review_queue_stats(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("o_orderkey") % 100 / 100.0), 4).alias("mean_confidence"))


RETRIES = "(SELECT ['PENDING', 'PROCESSING', 'COMPLETED', 'FAILED'][1 + event_id % 4] AS status, CASE event_type WHEN 'error' THEN 'CircuitBreaker' WHEN 'click' THEN 'NetworkError' WHEN 'view' THEN 'IncompleteJson' ELSE 'Other' END AS reason FROM events)"


@query(f"SELECT {', '.join(f'''count(*) FILTER (status = '{s}') AS {s.lower()}''' for s in ('PENDING', 'PROCESSING', 'COMPLETED', 'FAILED'))}, {', '.join(f'''count(*) FILTER (reason = '{r}') AS {n}''' for r, n in (('CircuitBreaker', 'circuit_breaker'), ('NetworkError', 'network_error'), ('IncompleteJson', 'incomplete_json')))} FROM {RETRIES}")
def retry_stats(t):
    status = F.element_at(F.array(*map(F.lit, ("PENDING", "PROCESSING", "COMPLETED", "FAILED"))), (F.col("event_id") % 4 + 1).cast("int"))
    kind = F.col("event_type")
    reason = F.when(kind == "error", "CircuitBreaker").when(kind == "click", "NetworkError").when(kind == "view", "IncompleteJson").otherwise("Other")
    return Q.retry_counts(t.events.select(status.alias("status"), reason.alias("reason")))


@query("SELECT (SELECT count(*) FROM lineitem) AS total_offers, (SELECT count(*) FROM lineitem WHERE l_partkey % 3 = 0) AS curated_offers, (SELECT count(DISTINCT p_name) FROM part) AS masters, (SELECT count(*) FROM part) AS aliases, (SELECT count(*) FROM part WHERE p_size <= 10) AS pending_aliases, (SELECT count(*) FROM part WHERE p_size > 45) AS rejected_aliases")
def curation_stats(t):
    lines = t.lineitem.agg(F.count("*").alias("total_offers"), F.count_if(F.col("l_partkey") % 3 == 0).alias("curated_offers"))
    parts = t.part.agg(F.countDistinct("p_name").alias("masters"), F.count("*").alias("aliases"), F.count_if(F.col("p_size") <= 10).alias("pending_aliases"), F.count_if(F.col("p_size") > 45).alias("rejected_aliases"))
    return lines.crossJoin(parts)  # one row each


@query(f"SELECT count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'CONFIRMED' AND made >= date_trunc('day', TIMESTAMP '{TODAY}')) AS confirmed_today, count(*) FILTER (status <> 'PENDING' AND made >= date_trunc('day', TIMESTAMP '{TODAY}')) AS processed_today, round(avg(CASE WHEN status = 'PENDING' THEN s END), 6) AS mean_pending_score, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS active_requests, (SELECT count(*) FROM part WHERE p_size > 5) AS active_offers, (SELECT count(*) FROM nation WHERE n_regionkey < 3) AS monitored_groups FROM {MATCHES}")
def system_stats(t):
    pending, today = F.col("status") == "PENDING", F.col("made") >= F.date_trunc("day", F.lit(TODAY).cast("timestamp")).cast("timestamp_ntz")
    m = matches(t).agg(F.count_if(pending).alias("pending"), F.count_if((F.col("status") == "CONFIRMED") & today).alias("confirmed_today"), F.count_if(~pending & today).alias("processed_today"), F.round(F.avg(F.when(pending, F.col("s"))), 6).alias("mean_pending_score"))
    n = lambda df, cond, name: df.agg(F.count_if(cond).alias(name))
    return m.crossJoin(n(t.orders, F.col("o_orderstatus") == "O", "active_requests")).crossJoin(n(t.part, F.col("p_size") > 5, "active_offers")).crossJoin(n(t.nation, F.col("n_regionkey") < 3, "monitored_groups"))  # one row each


@query(f"SELECT count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'CONFIRMED' AND made >= date_trunc('day', TIMESTAMP '{TODAY}')) AS confirmed_today, count(*) FILTER (status = 'REJECTED' AND made >= date_trunc('day', TIMESTAMP '{TODAY}')) AS rejected_today, count(DISTINCT l_partkey) FILTER (status = 'PENDING') AS pending_offers, count(DISTINCT l_orderkey) FILTER (status = 'PENDING') AS pending_requests, (SELECT round(100 * avg(s), 6) FROM (SELECT s FROM {MATCHES} WHERE status = 'PENDING' ORDER BY s DESC LIMIT 100)) AS mean_confidence FROM {MATCHES}")
def match_review_stats(t):
    m, pending = matches(t), F.col("status") == "PENDING"
    today = F.col("made") >= F.date_trunc("day", F.lit(TODAY).cast("timestamp")).cast("timestamp_ntz")
    one = m.agg(F.count_if(pending).alias("pending"), F.count_if((F.col("status") == "CONFIRMED") & today).alias("confirmed_today"), F.count_if((F.col("status") == "REJECTED") & today).alias("rejected_today"), F.countDistinct(F.when(pending, F.col("l_partkey"))).alias("pending_offers"), F.countDistinct(F.when(pending, F.col("l_orderkey"))).alias("pending_requests"))
    best = m.filter(pending).orderBy(F.desc("s")).limit(100).agg(F.round(100 * F.coalesce(F.avg("s"), F.lit(0.0)), 6).alias("mean_confidence"))
    return one.crossJoin(best)  # one row each


@query("SELECT o_orderstatus, round(avg(queue), 4) AS mean_queue, round(avg(ms - queue), 4) AS mean_processing, sum(queue)::BIGINT AS queue_ms FROM (SELECT o_orderstatus, o_orderkey % 500 AS ms, (o_orderkey % 500) // 10 AS queue FROM orders) GROUP BY 1")
def ai_wait_split(t):
    d = t.orders.select("o_orderstatus", Q.wait_split(F.col("o_orderkey") % 500).alias("w"))
    return d.groupBy("o_orderstatus").agg(F.round(F.avg("w.queue"), 4).alias("mean_queue"), F.round(F.avg("w.processing"), 4).alias("mean_processing"), F.sum("w.queue").alias("queue_ms"))


@query("SELECT count(*) FILTER (a = 'Approved') AS approved, count(*) FILTER (a = 'Queued') AS queued, count(*) FILTER (a = 'Blocked') AS blocked, round(coalesce(avg(CASE WHEN a = 'Approved' THEN c END), 0), 6) AS mean_confidence, round(count(*) FILTER (a = 'Approved' AND o) / greatest(count(*) FILTER (a = 'Approved'), 1), 6) AS override_rate FROM (SELECT CASE WHEN l_suppkey % 50 = 0 THEN 'Blocked' WHEN l_tax > 0.07 THEN 'Queued' WHEN l_quantity / 50 >= 0.85 THEN 'Approved' ELSE 'Queued' END AS a, l_quantity / 50 AS c, l_linestatus = 'F' AS o FROM lineitem)")
def auto_approve_stats(t):
    s = F.col("l_quantity") / 50
    d = t.lineitem.select(K.decision(F.col("l_suppkey") % 50 == 0, F.col("l_tax") > 0.07, s, F.lit(0.85)).alias("action"), s.alias("confidence"), (F.col("l_linestatus") == "F").alias("overridden"))
    return Q.approvals(d, "action", "confidence", "overridden")


@query("SELECT event_type, n, round(mean, 6) AS mean_ms, p95, round(n / total * 1000, 6) AS per_second FROM (SELECT event_type, any_value(n) AS n, any_value(total) AS total, avg(v) AS mean, quantile_disc(v, 0.95) AS p95 FROM (SELECT event_type, floor(value * 10)::BIGINT AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY event_type) AS n, sum(floor(value * 10)::BIGINT) OVER (PARTITION BY event_type) AS total FROM events) WHERE r <= 100 GROUP BY 1)")
def processing_metrics(t):
    d = t.events.select("event_type", "ts", "event_id", F.floor(F.col("value") * 10).cast("long").alias("v"))
    return Q.recent_processing(d, ["event_type"], ["ts", "event_id"], "v", 100)


@query("SELECT lower(trim(p_name)) AS name, count(*) AS n, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem JOIN part ON p_partkey = l_partkey WHERE lower(trim(p_name)) NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 50) GROUP BY 1")
def uncurated_names(t):
    curated = t.part.filter("p_size = 50").select(F.lower("p_name").alias("name"))
    named = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.lower(F.trim("p_name")).alias("name"), "l_shipdate")
    return named.join(curated, "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))


_STRATEGIES = {"embedding": "l_quantity / 50", "fuzzy": "l_discount * 10", "historical": "l_tax * 10"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS strategy, count(*) AS n, round(avg({e}), 6) AS mean, count(*) FILTER ({e} >= 0.85) AS high, count(*) FILTER ({e} < 0.5) AS low FROM lineitem" for k, e in _STRATEGIES.items()))
def strategy_stats(t):
    return Q.strategies(t.lineitem, {k: F.expr(e) for k, e in _STRATEGIES.items()})


@query("SELECT count(*) AS candidates_in, count(*) FILTER (l_discount > 0.05) AS candidates_out, round(1 - count(*) FILTER (l_discount > 0.05) / count(*), 6) AS reduction, round(100.0 * count(*) FILTER (l_partkey % 4 < 3) / count(*), 2) AS hit_rate FROM lineitem")
def reduction_ratio(t):
    return Q.reduction(t.lineitem, F.col("l_discount") > 0.05, F.col("l_partkey") % 4 < 3)


_QUALITY = "0.25 * success + 0.25 * named + 0.15 * counted + 0.15 * priced + 15 * confidence + 0.05 * greatest(10000 - floor(latency), 0) / 100"


@query(f"""SELECT model, n, round(success, 4) AS success, round(named, 4) AS named, buckets, p50, p95, round({_QUALITY}, 6) AS quality FROM (
    SELECT event_type AS model, count(*) AS n, 100.0 * count(*) FILTER (ok) / count(*) AS success, 100.0 * count(*) FILTER (ok AND k % 7 > 0) / count(*) FILTER (ok) AS named, 100.0 * count(*) FILTER (ok AND k > 9) / count(*) FILTER (ok) AS counted, 100.0 * count(*) FILTER (ok AND k > 49) / count(*) FILTER (ok) AS priced,
        avg(CASE WHEN ok THEN k / 100.0::DOUBLE END) AS confidence, avg(v) AS latency, [count(*) FILTER (ok AND k < 20), count(*) FILTER (ok AND k BETWEEN 20 AND 39), count(*) FILTER (ok AND k BETWEEN 40 AND 59), count(*) FILTER (ok AND k BETWEEN 60 AND 79), count(*) FILTER (ok AND k >= 80)] AS buckets,
        list_sort(list(v))[1 + round((count(*) - 1) * 0.5)::INT] AS p50, list_sort(list(v))[1 + round((count(*) - 1) * 0.95)::INT] AS p95
    FROM (SELECT event_type, value > 3 AS ok, json_extract_string(props, '$.k')::BIGINT AS k, floor(value * 100)::BIGINT AS v FROM events) GROUP BY 1)""")
def model_quality(t):
    d = t.events.select(F.col("event_type").alias("model"), (F.col("value") > 3).alias("ok"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor(F.col("value") * 100).cast("long").alias("v"))
    return Q.model_quality(d, "model", "ok", {"named": F.col("k") % 7 > 0, "counted": F.col("k") > 9, "priced": F.col("k") > 49}, F.col("k") / 100.0, "v").select("model", "n", F.round("success", 4).alias("success"), F.round("named", 4).alias("named"), "buckets", "p50", "p95", F.round("quality", 6).alias("quality"))


BOUNDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0)


def _quantile_sql(q: float) -> str:
    cum = [f"c{i}" for i in range(len(BOUNDS))]
    low = [0.0, *BOUNDS]
    whens = " ".join(f"WHEN {c} >= {q} * n THEN {low[i]}::DOUBLE + {BOUNDS[i] - low[i]}::DOUBLE * ({q} * n - {cum[i - 1] if i else 0}) / ({c} - {cum[i - 1] if i else 0})" for i, c in enumerate(cum))
    return f"CASE {whens} ELSE {BOUNDS[-1]} END"


@query(f"SELECT start, event_type, n, round({_quantile_sql(0.5)}, 6) AS p50, round({_quantile_sql(0.95)}, 6) AS p95 FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, {', '.join(f'count(*) FILTER (value <= {b}) AS c{i}' for i, b in enumerate(BOUNDS))} FROM events GROUP BY 1, 2)")
def histogram_quantiles(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    h = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), *[F.count_if(F.col("value") <= b).alias(f"c{i}") for i, b in enumerate(BOUNDS)])
    counts = [F.col(f"c{i}") for i in range(len(BOUNDS))]
    return h.select(F.col("w.start").alias("start"), "event_type", "n", *[F.round(Q.histogram_quantile(q, F.col("n"), counts, BOUNDS), 6).alias(name) for q, name in ((0.5, "p50"), (0.95, "p95"))])


@query("SELECT stage, count(*) AS n, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, floor(quantile_cont(v, 0.5))::BIGINT AS median, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, round(stddev_pop(v), 6) AS deviation FROM (SELECT 'candidate_filter' AS stage, o_custkey % 100 AS v FROM orders UNION ALL SELECT 'ai_review', o_orderkey % 500 FROM orders) GROUP BY 1")
def stage_latency(t):
    return Q.latency(A.stage_rows(records(t), "record"), ["stage"], "duration_ms")


@query("SELECT o_orderkey AS match_id, o_totalprice AS final_score, o_orderkey % 500 AS ai_ms FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus = 'F'")
def analytics_records(t):
    return A.selected(A.sections(records(t), "record"), min_score=150000, ai_involved=True).select("match_id", "final_score", "ai_ms")


_SIDES = "SELECT '{0}' AS factor, count(*) AS total, count(*) FILTER (ok) AS confirmed, count(*) FILTER (NOT ok) AS rejected, round(count(*) FILTER (ok) / count(*), 6) AS rate, round(coalesce(avg(CASE WHEN ok THEN x END), 0), 6) AS avg_confirmed, round(coalesce(avg(CASE WHEN NOT ok THEN x END), 0), 6) AS avg_rejected, round(coalesce(avg(CASE WHEN ok THEN x END), 0) - coalesce(avg(CASE WHEN NOT ok THEN x END), 0), 6) AS difference FROM (SELECT l_returnflag = 'R' AS ok, {1} AS x FROM lineitem)"


@query(" UNION ALL ".join(_SIDES.format(n, e) for n, e in (("medication", "l_quantity / 50"), ("recency", "l_discount * 10"), ("rare", "CASE WHEN l_returnflag = 'R' THEN l_tax END"))))
def feedback_stats(t):
    ok = F.col("l_returnflag") == "R"
    d = t.lineitem.select(ok.alias("ok"), (F.col("l_quantity") / 50).alias("medication"), (F.col("l_discount") * 10).alias("recency"), F.when(ok, F.col("l_tax")).alias("rare"))
    return L.feedback_summary(d, ["medication", "recency", "rare"], F.col("ok"))


@query("SELECT s_suppkey, count(l_orderkey) AS offers, count(*) FILTER (l_returnflag = 'R') AS confirmed, count(*) FILTER (l_returnflag = 'A') AS rejected, round(CASE WHEN count(*) FILTER (l_returnflag IN ('R', 'A')) = 0 THEN 0 ELSE 100.0 * count(*) FILTER (l_returnflag = 'R') / count(*) FILTER (l_returnflag IN ('R', 'A')) END, 2) AS approval_pct, round(avg(l_quantity / 50), 6) AS mean_confidence, max(l_shipdate) AS last_activity FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_linenumber > 1 GROUP BY 1")
def supplier_activity(t):
    flag = F.col("l_returnflag")
    o = t.lineitem.filter("l_linenumber > 1").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("offers"), F.count_if(flag == "R").alias("confirmed"), F.count_if(flag == "A").alias("rejected"), F.round(F.avg(F.col("l_quantity") / 50), 6).alias("mean_confidence"), F.max("l_shipdate").alias("last_activity"))
    j = t.supplier.select("s_suppkey").join(o, "s_suppkey", "left").fillna(0, ["offers", "confirmed", "rejected"])
    return j.withColumn("approval_pct", Q.percent(F.col("confirmed"), F.col("confirmed") + F.col("rejected")))


# windows and orders


@query("SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, lower(event_type), CAST(ts AS DATE) ORDER BY ts, event_id) > 1 THEN 'EXPIRED' ELSE 'ACTIVE' END AS status FROM events")
def dedup_rewrite(t):
    marked = R.mark_duplicates(t.events.withColumn("status", F.lit("ACTIVE")), [F.col("user_id"), F.lower("event_type"), F.to_date("ts")], [F.asc("ts"), F.asc("event_id")])
    return R.set_status(marked, F.col("duplicate"), "EXPIRED").select("event_id", "status")


@query("SELECT event_id, coalesce(n >= 10 AND before > 0 AND (before - recent) / before > 0.2, false) AS anomaly FROM (SELECT event_id, avg(value) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent, avg(value) OVER (w ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS before, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def processor_anomaly(t):
    return L.rolling(t.events, ["user_id"], ["ts", "event_id"], "value", least=10).select("event_id", F.col("drop").alias("anomaly"))


@query("SELECT event_id, n >= 10 AND o / n > 0.1 AS alert FROM (SELECT event_id, count(*) OVER w AS n, count(*) FILTER (value > 15) OVER w AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW))")
def override_alerts(t):
    return L.rate_alerts(t.events, ["user_id"], "ts", F.col("value") > 15).select("event_id", "alert")


@query("SELECT * FROM (SELECT 'orders' AS table_name, o_orderkey AS id, o_orderdate AS made FROM orders ORDER BY made DESC, id DESC LIMIT 5) UNION ALL SELECT * FROM (SELECT 'lineitem', l_orderkey * 10 + l_linenumber, l_shipdate FROM lineitem ORDER BY 3 DESC, 2 DESC LIMIT 5) UNION ALL SELECT * FROM (SELECT 'events', event_id, ts FROM events ORDER BY 3 DESC, 2 DESC LIMIT 5)")
def latest_rows(t):
    sides = [("orders", t.orders, F.col("o_orderkey"), "o_orderdate"), ("lineitem", t.lineitem, F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_shipdate"), ("events", t.events, F.col("event_id"), "ts")]
    return union([R.most_recent(df.select(F.lit(n).alias("table_name"), k.alias("id"), F.col(at).alias("made")), "made", "id", 5) for n, df, k, at in sides])


@query(f"SELECT l_orderkey, l_linenumber, s FROM {MATCHES} WHERE status = 'PENDING' ORDER BY s, l_orderkey, l_linenumber LIMIT 20")
def lowest_confidence(t):
    return R.page(matches(t).filter("status = 'PENDING'"), [F.asc("s"), F.asc("l_orderkey"), F.asc("l_linenumber")], 20).select("l_orderkey", "l_linenumber", "s")


@query(f"SELECT l_orderkey, l_linenumber, made FROM {MATCHES} WHERE status = 'PENDING' AND s >= 0.9 ORDER BY made, l_orderkey, l_linenumber LIMIT 50")
def oldest_batch(t):
    return R.page(matches(t).filter("status = 'PENDING' AND s >= 0.9"), [F.asc("made"), F.asc("l_orderkey"), F.asc("l_linenumber")], 50).select("l_orderkey", "l_linenumber", "made")


SORTS = [("o_orderdate", "desc"), ("o_orderdate", "asc"), ("done_at", "desc"), ("done_at", "asc"), ("o_totalprice", "desc")]


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c} {d}' AS sort, row_number() OVER (ORDER BY {c} {d.upper()} NULLS {'FIRST' if d == 'desc' else 'LAST'}, o_orderkey)::INT AS place, o_orderkey FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS done_at FROM orders)) WHERE place BETWEEN 6 AND 15" for c, d in SORTS))
def sorted_pages(t):
    o = t.orders.withColumn("done_at", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    pages = []
    for c, d in SORTS:
        p = R.page(o, R.sort_by(c, d, ["o_orderdate", "done_at", "o_totalprice"], "o_orderkey"), 10, 5)
        place = F.row_number().over(Window.orderBy(*R.sort_by(c, d, ["o_orderdate", "done_at", "o_totalprice"], "o_orderkey"))) + 5  # ten rows
        pages.append(p.select(F.lit(f"{c} {d}").alias("sort"), place.alias("place"), "o_orderkey"))
    return union(pages)
