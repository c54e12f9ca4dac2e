"""Tables through each source and sink and back, catalogue queries, and raw SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkloom.plans.registry import query
from linkloom.session import forget_at_exit, shared_dir
from linkloom.sources import tables as S


def place(t) -> str:
    """A new folder of the shared one, which goes when the process ends."""
    return forget_at_exit(t.spark, f"{shared_dir(t.spark)}/file-{uuid.uuid4().hex}")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY 1")
def raw_sql_report(t):
    return S.raw_sql(t.spark, t.sf_dir, "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON c_custkey = o_custkey WHERE c_acctbal > :least GROUP BY 1", least=0)


_KIND = "CASE WHEN column_type LIKE '%[]' THEN 'array<float>' WHEN column_type = 'INTEGER' THEN 'int' WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type = 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, column_name, {_KIND} AS type, true AS nullable FROM (DESCRIBE {n})" for n in S.NAMES))
def column_profiles(t):
    parts = [S.columns_of(getattr(t, n), n) for n in S.NAMES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT p_partkey, p_name || ', \"' || p_brand || '\"' AS shown, p_retailprice FROM part")
def csv_round_trip(t):
    at = place(t)
    df = t.part.select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("shown"), "p_retailprice")
    S.write_csv(df, at)
    return S.read_csv(t.spark, at, df.schema)


@query("SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 3 > 0 THEN props END AS props FROM events")
def json_round_trip(t):
    at = place(t)
    df = t.events.select("event_id", "user_id", "event_type", "value", F.when(F.col("event_id") % 3 > 0, F.col("props")).alias("props"))
    S.write_json(df, at)
    return S.read_json(t.spark, at, df.schema)


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) <= 3")
def monthly_log(t):
    at = place(t)
    S.write_by_month(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", at)
    return t.spark.read.parquet(at).filter("year = 1996 AND month <= 3").select("o_orderkey", "year", "month")  # only these folders are read


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 1000")
def backup_copy(t):
    name = f"backup_{uuid.uuid4().hex}"
    S.backup(t.customer, name, place(t))
    return t.spark.table(name).filter("c_acctbal < 1000").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT n_name AS name, lower(n_name) AS english, unnest(CASE WHEN n_nationkey % 3 = 0 THEN [NULL] ELSE ['s' || n_nationkey, r_name] END) AS synonym FROM nation JOIN region ON r_regionkey = n_regionkey")
def dictionary_source(t):
    at = place(t)
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    synonyms = F.when(F.col("n_nationkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")), F.col("r_name")))
    entry = F.struct(F.col("n_name").alias("key"), F.struct(F.lower("n_name").alias("english"), synonyms.alias("synonyms")).alias("value"))
    n.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).coalesce(1).write.text(at)  # 25 names
    return S.dictionary(t.spark, at)


@query("SELECT n_name AS canonical_name, r_name AS strength, unnest(['a' || n_nationkey, 'b' || n_nationkey]) AS alias FROM nation JOIN region ON r_regionkey = n_regionkey")
def seed_source(t):
    at = place(t)
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey").cast("string")
    item = F.struct(F.col("n_name").alias("canonical_name"), F.col("r_name").alias("strength"), F.array(F.concat(F.lit("a"), key), F.concat(F.lit("b"), key)).alias("aliases"))
    n.agg(F.to_json(F.struct(F.lit("1").alias("version"), F.collect_list(item).alias("medications"))).alias("value")).coalesce(1).write.text(at)  # 25 names
    masters, aliases = S.seed(t.spark, at)
    return masters.select("canonical_name", "strength").join(aliases, "canonical_name")


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, 1::BIGINT AS files, true AS known FROM (SELECT 1)" for n in ("orders", "part", "events")))
def storage_stats(t):
    parts = [S.storage_of(getattr(t, n), n) for n in ("orders", "part", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("table_name", "files", (F.col("bytes") > 0).alias("known"))
