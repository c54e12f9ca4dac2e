"""Joins, lookups and table rewrites: enrichment, bridges, updates from joins, upserts, decisions, retention, queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import scoring as Z
from linkloom.operators import relational as R
from linkloom.plans.dashboards import MATCHES, matches
from linkloom.plans.registry import query

NOW = "1998-06-15 12:00:00"


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# sources and lookups


@query("SELECT * FROM orders WHERE o_orderkey = 4242")
def point_lookup(t):
    return R.by_id(t.orders, "o_orderkey", 4242)


_PREVIEWS = [("orders", "o_orderkey", "o_orderstatus"), ("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name")]


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{t}' AS table_name, {k}::BIGINT AS id, {v} AS shown FROM {t} ORDER BY 2 LIMIT 3)" for t, k, v in _PREVIEWS))
def table_previews(t):
    return union([getattr(t, n).orderBy(k).limit(3).select(F.lit(n).alias("table_name"), F.col(k).cast("long").alias("id"), F.col(v).alias("shown")) for n, k, v in _PREVIEWS])


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def recent_audits(t):
    return R.most_recent(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", "o_orderkey", 100)


# filters


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN error IS NOT NULL THEN 'Error' WHEN processed_at IS NOT NULL THEN 'Processed' ELSE 'Unprocessed' END AS status FROM (SELECT CASE WHEN value >= 5 THEN ts END AS processed_at, CASE WHEN event_type = 'error' THEN props END AS error FROM events)) GROUP BY 1")
def processing_status(t):
    d = t.events.select(F.when(F.col("value") >= 5, F.col("ts")).alias("processed_at"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"))
    return d.groupBy(R.status_of(F.col("processed_at"), F.col("error")).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE value < 5 AND event_type <> 'error' OR event_type = 'error' AND ts < TIMESTAMP '2024-01-15' AND NOT starts_with(props, '{\"k\": 1')")
def reprocess_candidates(t):
    e = F.col("event_type") == "error"
    waiting = (F.col("value") < 5) & ~e
    again = e & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")) & ~F.col("props").startswith('{"k": 1')
    return t.events.filter(waiting | again).select("event_id")


_AUDIT = "(SELECT o_orderkey AS match_id, o_orderpriority AS event_type, o_orderdate AS ts, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice / 300000 END AS confidence, o_orderstatus = 'P' AS overridden, o_custkey AS override_by FROM orders)"


def audit(t):
    c = F.col
    return t.orders.select(c("o_orderkey").alias("match_id"), c("o_orderpriority").alias("event_type"), c("o_orderdate").alias("ts"), F.when(c("o_orderkey") % 7 > 0, c("o_totalprice") / 300000).alias("confidence"), (c("o_orderstatus") == "P").alias("overridden"), c("o_custkey").alias("override_by"))


@query(f"SELECT match_id FROM {_AUDIT} WHERE event_type = '1-URGENT' AND ts BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1997-12-31' AND confidence >= 0.2 AND confidence <= 0.9 AND NOT overridden")
def audit_search(t):
    return R.audit_filter(audit(t), event_type="1-URGENT", start="1994-01-01", end="1997-12-31", min_confidence=0.2, max_confidence=0.9, overridden=False).select("match_id")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%ring%' OR lower(p_brand) LIKE '%#3%' OR lower(p_type) LIKE '%econ%'")
def search_columns(t):
    return t.part.filter(F.col("p_name").contains("ring") | R.any_contains(["p_brand"], "#3") | R.any_contains(["p_type"], "ECON")).select("p_partkey")


_TIMES = {"night": "22:00-06:00", "day": "09:00-17:00", "broken": "9 to 5", "wrong": "25:00-26:00", "empty": "08:00-08:00"}
_MIN = "(hour(ts) * 60 + minute(ts))"


@query(" UNION ALL ".join(f"SELECT '{n}' AS schedule, count(*) AS n FROM events WHERE {c}" for n, c in (("night", f"{_MIN} >= 1320 OR {_MIN} < 360"), ("day", f"{_MIN} >= 540 AND {_MIN} < 1020"), ("broken", "true"), ("wrong", "true"), ("empty", "false"))))
def schedule_windows(t):
    m = F.hour("ts") * 60 + F.minute("ts")
    return union([t.events.filter(Z.in_schedule(m, s)).agg(F.lit(n).alias("schedule"), F.count("*").alias("n")) for n, s in _TIMES.items()])


# joins


@query("SELECT l_orderkey, l_linenumber, c_name, s_name, p_name, sn.n_name AS supplier_nation FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) sn ON sn.n_nationkey = s_nationkey WHERE l_returnflag = 'N' AND l_quantity > 45")
def confirm_list(t):
    out = t.lineitem.filter("l_returnflag = 'N' AND l_quantity > 45").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    out = out.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    sn = t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supplier_nation"))
    return out.join(sn, "s_nationkey", "left").select("l_orderkey", "l_linenumber", "c_name", "s_name", "p_name", "supplier_nation")


@query("SELECT l_orderkey, l_linenumber, o_totalprice, p_name, c_name, s_name, cn.n_name AS customer_nation, cr.r_name AS customer_region FROM lineitem JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey JOIN (SELECT * FROM part WHERE p_size > 25) ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey LEFT JOIN region cr ON cr.r_regionkey = cn.n_regionkey WHERE l_linenumber = 1")
def review_items(t):
    out = t.lineitem.filter("l_linenumber = 1").join(t.orders.filter("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.filter("p_size > 25"), F.col("l_partkey") == F.col("p_partkey"))
    out = out.join(t.customer.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left").join(t.supplier.filter("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation"), F.col("r_name").alias("customer_region"))
    return out.join(places, "c_nationkey", "left").select("l_orderkey", "l_linenumber", "o_totalprice", "p_name", "c_name", "s_name", "customer_nation", "customer_region")


@query("SELECT doc_id, coalesce(b.text, '[message gone]') AS message, coalesce(c_name, 'Unknown') AS sender FROM (SELECT doc_id, doc_id % 60 AS item_id, doc_id % 2000 AS c_custkey FROM labels) LEFT JOIN benchmark b USING (item_id) LEFT JOIN customer USING (c_custkey)")
def review_texts(t):
    q = t.labels.select("doc_id", (F.col("doc_id") % 60).alias("item_id"), (F.col("doc_id") % 2000).alias("c_custkey"))
    return q.join(t.benchmark, "item_id", "left").join(t.customer, "c_custkey", "left").select("doc_id", F.coalesce("text", F.lit("[message gone]")).alias("message"), F.coalesce("c_name", F.lit("Unknown")).alias("sender"))


@query("WITH d AS (SELECT o_custkey, lower(o_orderpriority) AS p FROM orders GROUP BY 1, 2 HAVING count(*) > 3) SELECT o_orderkey, o_custkey FROM orders JOIN d ON d.o_custkey = orders.o_custkey AND d.p = lower(o_orderpriority)".replace("o_orderkey, o_custkey", "o_orderkey, orders.o_custkey AS o_custkey"))
def dup_pair_rows(t):
    o = t.orders.withColumn("p", F.lower("o_orderpriority"))
    dup = o.groupBy("o_custkey", "p").agg(F.count("*").alias("n")).filter("n > 3").select("o_custkey", "p")
    return o.join(dup, ["o_custkey", "p"]).select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT o_custkey AS c_custkey, n_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey")
def participant_groups(t):
    bridge = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("o_custkey").alias("c_custkey"), F.col("s_nationkey").alias("n_nationkey")).distinct()
    return bridge.join(t.nation, "n_nationkey").select("c_custkey", "n_name")


@query("SELECT s_nationkey AS grp, first, row_number() OVER (ORDER BY first)::INT AS place FROM (SELECT s_nationkey, min(s_suppkey) AS first FROM supplier GROUP BY 1) WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey < 20)")
def common_groups_ordered(t):
    mine = t.customer.filter("c_custkey < 20").select(F.col("c_nationkey").alias("grp"))
    theirs = t.supplier.groupBy(F.col("s_nationkey").alias("grp")).agg(F.min("s_suppkey").alias("first"))
    return R.common(mine, theirs, "grp", "first")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, c_custkey) AS customer FROM orders LEFT JOIN (SELECT c_name, min(c_custkey) AS c_custkey FROM customer WHERE c_acctbal > 0 GROUP BY 1) ON c_name = 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0')")
def identity_migration(t):
    o = t.orders.withColumn("customer", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")))
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    known = t.customer.filter("c_acctbal > 0").select(F.col("c_name").alias("k"), F.col("c_custkey").alias("v"))
    return R.filled_from(o, "customer", name, known).select("o_orderkey", "customer")


@query("SELECT c_custkey, n_nationkey FROM customer, nation WHERE c_name = 'Customer#000000007' AND n_name IN ('NATION_3', 'NATION_4')")
def keyed_product(t):
    # the keys leave a row and two; the optimiser moves both filters below the product
    return t.customer.crossJoin(t.nation).filter((F.col("c_name") == "Customer#000000007") & F.col("n_name").isin("NATION_3", "NATION_4")).select("c_custkey", "n_nationkey")


# rewrites


@query("WITH a AS (SELECT lower(p_name) AS alias, count(*) AS n, min(p_partkey) AS f, max(p_partkey) AS l FROM part WHERE p_size <= 20 GROUP BY 1), b AS (SELECT lower(p_name) AS alias, min(p_partkey) AS f, max(p_partkey) AS l FROM part WHERE p_size > 10 GROUP BY 1) SELECT coalesce(a.alias, b.alias) AS alias, coalesce(a.n, 1) AS occurrences, coalesce(a.f, b.f) AS first_seen, greatest(a.l, b.l) AS last_seen FROM a FULL JOIN b ON a.alias = b.alias")
def save_or_update(t):
    side = lambda cond, n: t.part.filter(cond).groupBy(F.lower("p_name").alias("alias")).agg(n.alias("occurrences"), F.min("p_partkey").alias("first_seen"), F.max("p_partkey").alias("last_seen"))
    return R.touched(side("p_size <= 20", F.count("*")), side("p_size > 10", F.max(F.lit(1).cast("long"))), "alias")


@query("SELECT coalesce(a.k, b.k) AS jid, coalesce(b.name, a.name) AS name, coalesce(b.n, a.n)::INT AS members, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'kept' ELSE 'updated' END AS action FROM (SELECT r_regionkey AS k, lower(r_name) AS name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey < 3 AND n_nationkey % 2 = 0 GROUP BY 1, 2) a FULL JOIN (SELECT r_regionkey AS k, r_name AS name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey > 0 GROUP BY 1, 2) b ON a.k = b.k")
def group_sync(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    of = lambda df, name: df.groupBy(F.col("r_regionkey").alias("jid"), name.alias("name")).agg(F.collect_list("n_name").alias("members"))
    there = of(n.filter("r_regionkey < 3 AND n_nationkey % 2 = 0"), F.lower("r_name"))
    return R.sync_groups(there, of(n.filter("r_regionkey > 0"), F.col("r_name")), "jid")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size < 10 THEN p_partkey END, m) AS master FROM part LEFT JOIN (SELECT lower(trim(p_name)) AS alias, min(p_partkey) AS m FROM part WHERE p_size > 40 GROUP BY 1) ON alias = lower(trim(p_name))")
def backfill_ids(t):
    known = t.part.filter("p_size > 40").select(F.lower(F.trim("p_name")).alias("k"), F.col("p_partkey").alias("v"))
    p = t.part.withColumn("master", F.when(F.col("p_size") < 10, F.col("p_partkey")))
    return R.filled_from(p, "master", F.lower(F.trim("p_name")), known).select("p_partkey", "master")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN hit THEN 'CONFIRMED' ELSE status END AS status, CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '1970-01-01' END AS confirmed_at, CASE WHEN hit AND l_linenumber <> 2 THEN 'user' || l_suppkey END AS matched_by FROM (SELECT *, status = 'PENDING' AND s >= 0.8 AS hit FROM {MATCHES})")
def confirm_matches(t):
    by = F.when(F.col("l_linenumber") == 2, " ").otherwise(F.concat(F.lit("user"), F.col("l_suppkey").cast("string")))
    m = R.confirmed(matches(t), (F.col("status") == "PENDING") & (F.col("s") >= 0.8), "CONFIRMED", NOW, by)
    return m.select("l_orderkey", "l_linenumber", "status", F.coalesce("confirmed_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("confirmed_at"), "matched_by")


@query("SELECT p_partkey AS id, greatest(0, p_size % 5 + coalesce(s, 0))::BIGINT AS n FROM part LEFT JOIN (SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END) AS s FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def counter_steps(t):
    steps = t.lineitem.select(F.col("l_partkey").alias("id"), F.when(F.col("l_returnflag") == "R", 1).otherwise(-1).alias("step"))
    return R.counted(t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).cast("long").alias("n")), steps, "id")


_KEEP = "SELECT '{0}' AS table_name, count(*) AS kept FROM {1} WHERE NOT ({2})"


@query(" UNION ALL ".join(_KEEP.format(*x) for x in (("raw_messages", "events", "ts < TIMESTAMP '2024-01-25' - INTERVAL 14 DAY AND value >= 5"), ("audit_logs", "orders", "o_orderdate < TIMESTAMP '1998-12-01' - INTERVAL 365 DAY"), ("offers", "lineitem", "l_shipdate < TIMESTAMP '1998-12-01' - INTERVAL 90 DAY"), ("requests", "orders", "o_orderdate < TIMESTAMP '1998-12-01' - INTERVAL 90 DAY AND o_orderstatus <> 'P'"))))
def retention_rules(t):
    ts = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp"))
    kept = [("raw_messages", R.retained(ts(t.events, "ts"), "ts", "2024-01-25", 14, F.col("value") >= 5)), ("audit_logs", R.retained(ts(t.orders, "o_orderdate"), "o_orderdate", "1998-12-01", 365)), ("offers", R.retained(ts(t.lineitem, "l_shipdate"), "l_shipdate", "1998-12-01", 90)), ("requests", R.retained(ts(t.orders, "o_orderdate"), "o_orderdate", "1998-12-01", 90, F.col("o_orderstatus") != "P"))]
    return union([df.agg(F.lit(n).alias("table_name"), F.count("*").alias("kept")) for n, df in kept])


@query("SELECT event_id, CASE WHEN a IS NULL THEN 'never approved' WHEN TIMESTAMP '2024-01-15 12:00:00' <= to_timestamp(floor(epoch(a))) + INTERVAL 30 MINUTE THEN 'undone' ELSE 'too late' END AS outcome FROM (SELECT event_id, CASE WHEN value > 5 THEN ts END AS a FROM events)".replace("to_timestamp(floor(epoch(a)))", "make_timestamp((floor(epoch(a)) * 1000000)::BIGINT)"))
def undo_window(t):
    d = t.events.withColumn("approved_at", F.when(F.col("value") > 5, F.col("ts")))
    return R.undone(d, "approved_at", "2024-01-15 12:00:00").select("event_id", F.when(F.col("undone"), "undone").when(~F.col("undone"), "too late").otherwise("never approved").alias("outcome"))


@query("SELECT id AS o_orderkey, o.o_orderkey IS NOT NULL AND o_orderstatus <> 'F' AS ok, CASE WHEN o.o_orderkey IS NULL THEN 'not found' WHEN o_orderstatus = 'F' THEN 'already decided' END AS reason FROM (SELECT DISTINCT (l_orderkey * 2)::BIGINT AS id FROM lineitem WHERE l_quantity > 40) LEFT JOIN orders o ON o.o_orderkey = id")
def bulk_results(t):
    ids = t.lineitem.filter("l_quantity > 40").select((F.col("l_orderkey") * 2).alias("o_orderkey"))
    return R.bulk(ids, t.orders, "o_orderkey", F.when(F.col("o_orderstatus") == "F", "already decided"))


@query(f"SELECT l_orderkey, l_linenumber, 'match' AS kind, 'CONFIRMED' AS value FROM {MATCHES} WHERE status = 'PENDING' AND s >= 0.9 UNION ALL SELECT l_orderkey, l_linenumber, 'feedback', round(s, 4)::VARCHAR FROM {MATCHES} WHERE status = 'PENDING' AND s >= 0.9")
def auto_confirm(t):
    changed, feedback = R.auto_confirmed(matches(t), F.col("s") >= 0.9, NOW)
    return changed.select("l_orderkey", "l_linenumber", F.lit("match").alias("kind"), F.col("status").alias("value")).unionByName(feedback.select("l_orderkey", "l_linenumber", F.lit("feedback").alias("kind"), F.round("s", 4).cast("string").alias("value")))


# queues and routes


_QUEUE = "(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'COMPLETED' ELSE 'PENDING' END AS status, CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 8 ELSE 3 END AS priority, o_orderdate AS created_at, o_orderdate + INTERVAL (o_orderkey % 30) DAY AS next_at, (o_orderkey % 4)::INT AS attempts FROM orders)"


def queue(t):
    p = F.col("o_orderpriority")
    return t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "COMPLETED").otherwise("PENDING").alias("status"), F.when(p == "1-URGENT", 10).when(p == "2-HIGH", 8).otherwise(3).alias("priority"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.make_dt_interval(days=F.col("o_orderkey") % 30)).alias("next_at"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"))


@query(f"SELECT id, 'PROCESSING' AS status, priority FROM {_QUEUE} WHERE status = 'PENDING' AND next_at <= TIMESTAMP '1996-01-01' ORDER BY priority DESC, created_at, id LIMIT 40")
def queue_dequeue(t):
    return R.dequeued(queue(t), "1996-01-01", 40).select("id", "status", "priority")


@query(f"SELECT id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status, TIMESTAMP '1996-01-01 00:01:00' AS next_at FROM {_QUEUE} WHERE status = 'PENDING'")
def queue_fail(t):
    return R.failed(queue(t).filter("status = 'PENDING'"), "1996-01-01").select("id", "attempts", "status", "next_at")


@query("SELECT conv_id, CASE WHEN c < 0.4 THEN 'review' WHEN c < 0.7 THEN 'second_pass' ELSE 'accept' END AS route FROM (SELECT conv_id, avg((length(text) % 100) / 100.0::DOUBLE) AS c FROM conversations GROUP BY 1)")
def multi_pass_routes(t):
    g = t.conversations.groupBy("conv_id").agg(F.avg(F.length("text") % 100 / 100.0).alias("c"))
    return g.select("conv_id", R.pass_route(F.col("c")).alias("route"))


@query("SELECT event_id, CASE WHEN a < 3 THEN ts + INTERVAL (30 * pow(2, a)::BIGINT) SECOND ELSE TIMESTAMP '1970-01-01' END AS again FROM (SELECT event_id, date_trunc('second', ts) AS ts, event_id % 6 AS a FROM events)")
def retry_schedule(t):
    again = Z.retry_at(F.col("event_id") % 6, F.col("ts")).cast("timestamp_ntz")
    return t.events.select("event_id", F.coalesce(again, F.lit("1970-01-01").cast("timestamp_ntz")).alias("again"))
