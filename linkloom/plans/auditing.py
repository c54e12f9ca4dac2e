"""Audit records and pools of examples on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import audit as A
from linkloom.plans.registry import query


def records(t):
    """Orders as stored JSON records of two stages."""
    at = F.col("o_orderdate").cast("timestamp")

    def stage(name, ms, n):
        return F.struct(F.lit(name).alias("stage"), at.alias("started_at"), ms.alias("duration_ms"), F.lit(n).alias("candidates_in"), F.lit(n // 2).alias("candidates_out"))

    stages = F.array(stage("candidate_filter", F.col("o_custkey") % 100, 50), stage("ai_review", F.col("o_orderkey") % 500, 10))
    model = F.when(F.col("o_orderstatus") == "F", F.struct(F.lit("m").alias("model"), (F.col("o_orderkey") % 500).alias("latency_ms")))
    fields = F.struct(F.col("o_orderkey").alias("match_id"), F.col("o_totalprice").alias("final_score"), stages.alias("pipeline_stages"), model.alias("ai_record"), model.isNotNull().alias("ai_involved"))
    return t.orders.select(F.to_json(fields).alias("record"))


@query("""SELECT o_orderkey AS match_id, 0 AS nth, 'candidate_filter' AS stage, o_custkey % 100 AS duration_ms, 25::BIGINT AS candidates_out, epoch_ms(o_orderdate) + o_custkey % 100 AS completed_ms, false AS involves_ai FROM orders
    UNION ALL SELECT o_orderkey, 1, 'ai_review', o_orderkey % 500, 5, epoch_ms(o_orderdate) + o_orderkey % 500, true FROM orders""")
def audit_stages(t):
    rows = A.stage_rows(records(t), "record")
    return rows.select("match_id", "nth", "stage", "duration_ms", "candidates_out", F.unix_millis("completed_at").alias("completed_ms"), "involves_ai")


@query("SELECT o_orderkey AS match_id, o_totalprice AS final_score, o_orderstatus = 'F' AS ai_involved, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 500 END AS ai_ms, o_custkey % 100 AS filter_ms FROM orders")
def audit_sections(t):
    d = A.sections(records(t), "record")
    return d.select("match_id", "final_score", "ai_involved", "ai_ms", F.col("stage_ms")["candidate_filter"].alias("filter_ms"))


_LIKE = "abs(strlen(e.t) - strlen(x.t)) < 50 AND substr(e.t, 1, least(20, length(e.t), length(x.t))) = substr(x.t, 1, least(20, length(e.t), length(x.t)))"
_FIRST = f"list_position(list_transform(p, lambda e: {_LIKE}), true)"
_WORST = "list_position(list_transform(p, lambda e: e.c * 1000000 + e.u), list_min(list_transform(p, lambda e: e.c * 1000000 + e.u)))"


@query(f"""SELECT p_brand, unnest(range(1, len(p) + 1))::INT AS place, unnest(list_transform(p, lambda e: e.k)) AS p_partkey, unnest(list_transform(p, lambda e: e.t)) AS p_name, unnest(list_transform(p, lambda e: e.c)) AS confirmations, unnest(list_transform(p, lambda e: e.u)) AS usage FROM (
    SELECT p_brand, list_reduce(list({{'k': p_partkey, 't': p_name, 'c': 1::BIGINT, 'u': 0::BIGINT}} ORDER BY p_partkey), lambda p, x: CASE WHEN {_FIRST} > 0 THEN list_transform(p, lambda e, i: CASE WHEN i = {_FIRST} THEN {{'k': e.k, 't': e.t, 'c': e.c + 1, 'u': e.u}} ELSE e END)
        WHEN len(p) < 10 THEN list_append(p, x) ELSE list_transform(p, lambda e, i: CASE WHEN i = {_WORST} THEN x ELSE e END) END, []::STRUCT(k BIGINT, t VARCHAR, c BIGINT, u BIGINT)[]) AS p FROM part GROUP BY 1)""")
def example_pools(t):
    return A.example_pool(t.part, "p_brand", ["p_partkey"], "p_name", F.lit(1), F.lit(0), 10)
