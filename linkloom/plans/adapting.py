"""Priors, decay, thresholds, uncertainty, learned aliases, resolving and fallbacks on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions.similarity import resolver_similarity
from linkloom.operators import adaptive as A
from linkloom.operators import linkage as K
from linkloom.plans.registry import query


@query("SELECT p_partkey, round(CASE WHEN p_size < 20 THEN 0.3 ELSE (1 - h / (p_size + h)) * p_retailprice / 2000 + h / (p_size + h) * 0.3 END, 6) AS weight FROM (SELECT *, 50 * pow(0.5, (p_partkey % 60) / 14.0::DOUBLE) AS h FROM part)")
def warm_start_blend(t):
    w = A.blended_weight(F.col("p_retailprice") / 2000, F.lit(0.3), F.col("p_size"), F.col("p_partkey") % 60, strength=50.0)
    return t.part.select("p_partkey", F.round(w, 6).alias("weight"))


@query("""SELECT l_orderkey, l_linenumber, round(a, 6) AS affinity, round(CASE WHEN l_linenumber >= 3 AND (l_orderkey % 5 >= 3 OR a < 0.5) THEN (a - 0.5) * 0.2 ELSE 0 END, 6) AS bonus FROM (
    SELECT *, CASE WHEN d > 90 THEN 0.5 WHEN d > 0 AND s > 0.5 THEN greatest(s - 0.01 * d, 0.5) WHEN d > 0 THEN least(s + 0.01 * d, 0.5) ELSE s END AS a FROM (
    SELECT l_orderkey, l_linenumber, l_quantity / 50 AS s, l_suppkey % 100 AS d FROM lineitem))""")
def affinity_decay(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", A.decayed_affinity(F.col("l_quantity") / 50, F.col("l_suppkey") % 100).alias("a"))
    bonus = A.historical_bonus(F.col("a"), F.col("l_orderkey") % 5, F.col("l_linenumber"), least=3)
    return d.select("l_orderkey", "l_linenumber", F.round("a", 6).alias("affinity"), F.round(bonus, 6).alias("bonus"))


@query("""SELECT event_type, unnest(o, recursive := true) FROM (SELECT event_type, list_reduce(list(v ORDER BY w), lambda a, x: {'t': CASE WHEN len(x) < 100 THEN a.t WHEN len(list_filter(x, lambda s: s >= a.t)) / 100.0 < 0.80 THEN round(greatest(0.30, a.t - 0.02), 9) WHEN len(list_filter(x, lambda s: s >= a.t)) / 100.0 > 0.90 THEN round(least(0.95, a.t + 0.02), 9) ELSE a.t END,
        'o': list_append(a.o, {'window': len(a.o)::BIGINT, 'threshold': a.t, 'accepted': len(list_filter(x, lambda s: s >= a.t))::BIGINT, 'total': len(x)::BIGINT, 'next': CASE WHEN len(x) < 100 THEN a.t WHEN len(list_filter(x, lambda s: s >= a.t)) / 100.0 < 0.80 THEN round(greatest(0.30, a.t - 0.02), 9) WHEN len(list_filter(x, lambda s: s >= a.t)) / 100.0 > 0.90 THEN round(least(0.95, a.t + 0.02), 9) ELSE a.t END})},
        {'t': 0.70::DOUBLE, 'o': []::STRUCT("window" BIGINT, threshold DOUBLE, accepted BIGINT, total BIGINT, "next" DOUBLE)[]}).o AS o
    FROM (SELECT event_type, w, list(s ORDER BY r) AS v FROM (SELECT *, (r - 1) // 100 AS w FROM (SELECT event_type, value / 20 AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events)) GROUP BY 1, 2) GROUP BY 1)""")
def adaptive_threshold(t):
    return A.adaptive_thresholds(t.events.withColumn("score", F.col("value") / 20), ["event_type"], ["ts", "event_id"], "score")


_U = "(('0x' || substr(md5(p_partkey::VARCHAR || ':' || i::VARCHAR || ':{0}:42:{1}'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE"
_N = "greatest(0.001, {1} + sqrt(-2 * ln(" + _U.format("{0}", "r") + ")) * cos(2 * pi() * " + _U.format("{0}", "a") + ") * 0.1 * {1})"


@query(f"""WITH x AS (SELECT p_partkey, p_size / 50 AS a, (p_partkey % 10) / 10 AS b, p_retailprice / 2000 AS c FROM part),
    w AS (SELECT *, {_N.format('name', '0.5::DOUBLE')} AS u, {_N.format('recency', '0.3::DOUBLE')} AS v, {_N.format('expiry', '0.2::DOUBLE')} AS z FROM x, (SELECT unnest(range(1, 21)) AS i)),
    s AS (SELECT p_partkey, any_value(0.5 * a + 0.3 * b + 0.2 * c) AS original, avg(k) AS mean, stddev_pop(k) AS deviation, min(k) AS low, max(k) AS high FROM (SELECT *, (u * a + v * b + z * c) / (u + v + z) AS k FROM w) GROUP BY 1)
    SELECT p_partkey, round(original, 6) AS original, round(mean, 6) AS mean, round(deviation, 6) AS deviation, round(low, 6) AS low, round(high, 6) AS high,
        CASE WHEN deviation < 0.05 THEN 'very_low' WHEN deviation < 0.10 THEN 'low' WHEN deviation < 0.15 THEN 'moderate' WHEN deviation < 0.20 THEN 'high' ELSE 'very_high' END AS level, deviation <= 0.15 AS certain FROM s""")
def score_uncertainty(t):
    parts = {"name": F.col("p_size") / 50, "recency": F.col("p_partkey") % 10 / 10, "expiry": F.col("p_retailprice") / 2000}
    u = A.uncertainty(F.col("p_partkey"), parts, {"name": 0.5, "recency": 0.3, "expiry": 0.2})
    one = t.part.select("p_partkey", u.alias("u")).select("p_partkey", "u.*")
    return one.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("original", "mean", "deviation", "low", "high")], "level", "certain")


@query("SELECT l_orderkey, l_linenumber, round(1 - 2 * least(sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 3), 0.5), 6) AS agreement FROM (SELECT *, (a + b + c) / 3 AS m FROM (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS c FROM lineitem))")
def ensemble_agreement(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(A.agreement([F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10]), 6).alias("agreement"))


@query("SELECT lower(p_name) AS alias, l_suppkey AS master, count(*) AS confirmations FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 42.5 GROUP BY 1, 2 HAVING count(*) >= 2")
def alias_learning(t):
    d = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    side = F.col("l_linenumber") == 1
    d = d.select((F.col("l_quantity") / 50).alias("s"), F.when(side, F.col("p_name")).otherwise("known").alias("o"), F.when(side, "known").otherwise(F.col("p_name")).alias("r"), F.when(~side, F.col("l_suppkey")).alias("om"), F.when(side, F.col("l_suppkey")).alias("rm"))
    return A.learned_aliases(d, "s", "o", "r", "om", "rm")


_EXAMPLE = "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'offer' WHEN '2-HIGH' THEN 'request' WHEN '5-LOW' THEN 'correction' ELSE 'edge' END AS category, o_custkey AS n FROM orders"


@query(f"SELECT o_orderkey, category, place FROM (SELECT *, row_number() OVER (ORDER BY CASE category WHEN 'offer' THEN 0 WHEN 'request' THEN 1 WHEN 'correction' THEN 2 ELSE 3 END, r)::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, o_orderkey) AS r FROM ({_EXAMPLE})) WHERE r <= CASE WHEN category IN ('offer', 'request') THEN 3 ELSE 1 END) WHERE place <= 7")
def few_shot_examples(t):
    p = F.col("o_orderpriority")
    d = t.orders.select("o_orderkey", F.when(p == "1-URGENT", "offer").when(p == "2-HIGH", "request").when(p == "5-LOW", "correction").otherwise("edge").alias("category"), F.col("o_custkey").alias("n"))
    return A.examples_for(d, "category", ["offer", "request"], [F.desc("n"), F.asc("o_orderkey")], 7).select("o_orderkey", "category", "place")


_CALL = "CASE WHEN a.s = 'open' AND x.t - a.l > 30 THEN 'half_open' ELSE a.s END"


@query(f"""SELECT unnest(ids) AS event_id, unnest(o, recursive := true) FROM (SELECT list(event_id ORDER BY t, event_id) AS ids, list_reduce(list({{'t': t, 'g': g}} ORDER BY t, event_id),
    lambda a, x: CASE WHEN {_CALL} = 'open' THEN {{'s': 'open', 'b': a.b, 'l': a.l, 'o': list_append(a.o, {{'allowed': false, 'state': 'open'}})}}
        WHEN x.g THEN {{'s': 'closed', 'b': 0::BIGINT, 'l': a.l, 'o': list_append(a.o, {{'allowed': true, 'state': 'closed'}})}}
        WHEN {_CALL} = 'half_open' OR a.b + 1 >= 3 THEN {{'s': 'open', 'b': a.b + 1, 'l': x.t, 'o': list_append(a.o, {{'allowed': true, 'state': 'open'}})}}
        ELSE {{'s': {_CALL}, 'b': a.b + 1, 'l': x.t, 'o': list_append(a.o, {{'allowed': true, 'state': {_CALL}}})}} END,
    {{'s': 'closed', 'b': 0::BIGINT, 'l': 0.0::DOUBLE, 'o': []::STRUCT(allowed BOOLEAN, state VARCHAR)[]}}).o AS o FROM (SELECT event_type, event_id, epoch(ts) AS t, value > 5 AS g FROM events) GROUP BY event_type)""")
def circuit_replay(t):
    d = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").cast("double").alias("at"), (F.col("value") > 5).alias("good"))
    return A.circuit_states(d, ["event_type"], ["at", "event_id"], "at", "good").select("event_id", "allowed", "state")


_MASTERS = "SELECT p_name AS canonical, min(p_partkey) AS master FROM part GROUP BY 1"
_ASKED = "SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, length(p_name) - 1) WHEN 2 THEN 'the ' || p_name ELSE 'no ' || p_name END AS name FROM part"


def dictionary(t):
    masters = t.part.groupBy(F.col("p_name").alias("canonical")).agg(F.min("p_partkey").alias("master"))
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    asked = t.part.select(F.when(k == 0, n).when(k == 1, F.substring(n, F.lit(1), F.length(n) - 1)).when(k == 2, F.concat(F.lit("the "), n)).otherwise(F.concat(F.lit("no "), n)).alias("name")).distinct()
    return asked, masters.select(F.concat(F.lit("the "), "canonical").alias("alias"), "master"), masters


@query(f"""WITH m AS ({_MASTERS}), n AS ({_ASKED}), f AS (SELECT * FROM (SELECT name, master, round(1 - levenshtein(name, canonical) / greatest(length(name), length(canonical)), 6) AS s, row_number() OVER (PARTITION BY name ORDER BY canonical, master) AS r FROM n JOIN m ON contains(canonical, name)) WHERE r <= 3 AND s >= 0.7),
    h AS (SELECT name, 0 AS k, 0 AS r, master, 1.0 AS s, 'alias' AS method FROM n JOIN m ON name = 'the ' || canonical UNION ALL SELECT name, 1, 0, master, 1.0, 'master' FROM n JOIN m ON name = canonical UNION ALL SELECT name, 2, r, master, s, 'fuzzy' FROM f),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k, r) AS p FROM h) WHERE p = 1)
    SELECT n.name, b.master, b.s::DOUBLE AS confidence, b.method, b.s >= 0.92 AS approved FROM n LEFT JOIN b ON b.name = n.name""")
def name_resolver(t):
    return K.resolve(*dictionary(t)).withColumn("confidence", F.round("confidence", 6))


_SIM = "(1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})))"


@query(f"""WITH p AS (SELECT a.p_name AS a, b.p_name AS b, a.k AS x, b.k AS y FROM (SELECT p_name, length(p_name) AS k FROM part GROUP BY ALL) a JOIN (SELECT p_name, length(p_name) AS k FROM part GROUP BY ALL) b ON a.p_name <= b.p_name AND split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1)),
    s AS (SELECT *, {_SIM.format('a', 'b')} AS s FROM p), r AS (SELECT a, b, CASE WHEN a = b THEN 'exact' WHEN x = y THEN 'same_master' WHEN s >= 0.7 THEN 'fuzzy' ELSE 'none' END AS method, CASE WHEN a = b THEN 1 WHEN x = y THEN 0.85 ELSE s END AS score FROM s)
    SELECT a, b, method, round(score::DOUBLE, 6) AS score, method <> 'none' AND score >= 0.85 AS high FROM r WHERE method <> 'none'""".replace("method <> 'none' AND score >= 0.85 AS high", "method IN ('exact', 'same_master') OR method = 'fuzzy' AND score >= 0.9 AS high"))
def fallback_matches(t):
    n = t.part.select("p_name").distinct().withColumn("w", F.substring_index("p_name", " ", 1))
    p = n.select("w", F.col("p_name").alias("a")).join(n.select("w", F.col("p_name").alias("b")), "w").filter("a <= b")
    a, b = F.col("a"), F.col("b")
    master = lambda c: F.when(a != b, F.length(c))
    s = resolver_similarity(a, b)
    m = K.fallback_match((master(a), master(b)), (F.lit(0.9), F.lit(0.8)), a == b, s, s)
    return K.by_strategy(p.select("a", "b", m.alias("match")), "deterministic").select("a", "b", "match.method", F.round("match.score", 6).alias("score"), "match.high")


_G = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH m AS ({_MASTERS}), n AS ({_ASKED}), x AS (SELECT name, canonical, {_G.format('name')} AS g, {_G.format('canonical')} AS h FROM n, m), s AS (SELECT name, canonical, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 6) AS s FROM x)
    SELECT name AS alias, 1 AS seen, canonical AS master, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, canonical) AS r FROM s WHERE s >= 0.6) WHERE r = 1""")
def alias_autoresolve(t):
    asked, _, masters = dictionary(t)
    return K.alias_suggestions(asked.withColumnRenamed("name", "alias"), masters)


@query("SELECT event_id, 'PENDING' AS status FROM events WHERE event_type IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-10' AND props NOT LIKE '%7%'")
def failed_reprocess(t):
    picked = t.events.filter(F.col("event_type").isin("click", "error") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & ~F.col("props").contains("7"))
    return picked.select("event_id", F.lit("PENDING").alias("status"))
