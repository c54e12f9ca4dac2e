"""The match path, rewrites, folds and sources on small frames: nulls, ties, empties, hot keys."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import folds
from linkloom.operators import learning as L
from linkloom.operators import linkage as K
from linkloom.operators import quality as Q
from linkloom.operators import relational as R
from linkloom.operators import search as S
from linkloom.sources import tables as T
from linkloom.streaming import ingest as I


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_candidates_are_bounded_by_requests(spark):
    asked = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "q int, b string")
    offers = spark.createDataFrame([(i, "x") for i in range(50)] + [(99, None)], "o int, b string")
    assert rows(K.candidates(asked, offers, ["b"], [F.desc("o")], 2).select("q", "o")) == [(1, 48), (1, 49), (2, 48), (2, 49)]


def test_pruning_falls_back_to_all(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (2, 11)], "q int, o int")
    hits = spark.createDataFrame([(1, 11, -3.0), (1, 12, -2.0), (1, 77, -9.0)], "q int, o int, score double")
    assert rows(K.pruned(pairs, hits, "q", "o", 1)) == [(1, 11), (2, 10), (2, 11)]


def test_new_matches_need_score_and_novelty(spark):
    scored = spark.createDataFrame([(1, 0.95), (2, 0.85), (3, 0.84), (4, 0.99)], "k int, s double")
    there = spark.createDataFrame([(4,), (4,)], "k int")
    assert rows(K.new_matches(scored, there, ["k"], "s")) == [(1, 0.95, "CONFIRMED"), (2, 0.85, "PENDING")]
    assert {r["status"] for r in K.new_matches(scored, there, ["k"], "s", automatic=False).collect()} == {"PENDING"}


def test_full_scorer_cases(spark):
    one = lambda **kw: spark.range(1).select(K.full_score({"medication": F.lit(kw.get("m", 0.9)), "ai": F.lit(1.0)}, {"medication": F.lit(0.8), "ai": F.lit(0.2)}, F.lit(kw.get("blocked", False)), F.lit(kw.get("other", 0.0)), F.lit(kw.get("days")).cast("int"), F.lit(kw.get("bonus", 0.0))).alias("s")).select("s.*").first()
    assert one()["total"] == pytest.approx(0.92 - 0.05) and one(days=99)["action"] == "Suggest"  # an unknown end counts half
    assert tuple(one(blocked=True)) == (0.0, "None", "Ignore") and one(days=-1)["total"] == 0.0 and one(m=0.5, days=99)["total"] == 0.0
    assert one(m=0.5, other=0.9, days=99)["total"] == pytest.approx(0.92) and one(days=99, bonus=0.2)["total"] == 1.0 and one(days=99, bonus=0.0005)["total"] == pytest.approx(0.92)


def test_full_scorer_at_the_end_of_a_band_equals_its_sql(spark, tmp_path):
    import duckdb

    from linkloom.plans import ORACLES, QUERIES

    # the first is 0.9 in decimals, just under it in the doubles of the SQL
    lines = spark.createDataFrame([(1, 6, 49.0, 0.08, 0.06, 38, 8), (2, 6, 50.0, 0.08, 0.06, 38, 8)], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_suppkey long, l_partkey long")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = QUERIES["full_scorer"](spark, str(tmp_path)).select("l_orderkey", "band", "action")
    assert rows(got) == sorted(db.execute(f"SELECT l_orderkey, band, action FROM ({ORACLES['full_scorer']})").fetchall(), key=str)


def test_means_hang_on_no_order(spark):
    means = {}
    for name, vs in (("up", [0.76, 0.74] * 60), ("down", [0.74] * 60 + [0.76] * 60), ("thirds", [1 / 3] * 7)):
        means[name] = rows(K.margins(spark.createDataFrame([("m", 0.9, v) for v in vs], "k string, p double, n double").coalesce(1), ["k"], "p", "n"))
    assert means["up"] == means["down"] == [("m", 0.9, 0.75, 0.76, True)] and means["thirds"][0][2] == 1 / 3
    odd = [("big", 1e200), ("big", 1.0), ("inf", float("inf")), ("inf", 1.0), ("nan", float("nan")), ("nan", 1.0), ("none", None), ("some", None), ("some", -0.5), ("tiny", 1e-30)]
    got = dict(rows(spark.createDataFrame(odd, "k string, v double").groupBy("k").agg(K.steady_mean(F.col("v")).alias("m"))))
    nan = got.pop("nan")
    assert nan != nan and got == {"big": 5e199, "inf": float("inf"), "none": None, "some": -0.5, "tiny": 1e-30}


def test_contrastive_checks_of_many_lines_and_repeated_orders(spark, tmp_path):
    from linkloom.plans import QUERIES

    # 0.9 against a mean of 0.75 that sums of doubles miss; order 95 is there twice and counts once, 80 has no lines
    lines = spark.createDataFrame([(90, 5, q) for q in [37.0] * 60 + [38.0] * 60] + [(95, 5, 45.0), (90, 4, 50.0)], "l_orderkey long, l_linenumber int, l_quantity double")
    orders = spark.createDataFrame([(90,), (95,), (95,), (80,), (60,)], "o_orderkey long")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(QUERIES["contrastive_checks"](spark, str(tmp_path))) == [(60, "below threshold", "skipped"), (80, "no negatives", "skipped"), (90, None, "passed"), (95, None, "failed")]


def test_hard_negatives_equal_the_whole_pool(spark):
    import hashlib

    names = [f"n{i}" for i in range(40)]
    related = {("n1", f"n{i}"): i % 2 for i in range(2, 9)} | {("n2", "n3"): 0}
    got = rows(K.hard_negatives(spark.createDataFrame([(*p, s) for p, s in related.items()], "a string, b string, stage int"), spark.createDataFrame([(n,) for n in names], "n string"), "n", 5).select("a", "b", "stage", "rank"))
    key = lambda b: hashlib.md5(f"{b}:42".encode()).hexdigest()
    want = [(a, b, s, r) for a in names for r, (s, _, b) in enumerate(sorted((related.get((a, b), 2), key(b), b) for b in names if b != a)[:5], 1)]
    assert got == sorted(want, key=str)


def test_priority_and_validity(spark):
    t = dt.datetime
    p = spark.createDataFrame([(1, "panadol", "بندول", "Low", t(2020, 1, 1), None), (2, "panadol", None, "High", t(2020, 1, 1), t(2020, 2, 1)), (3, "panadol", None, "Critical", t(2021, 1, 1), None), (4, "x", "panadol", "Critical", t(2020, 1, 1), None)], "p_partkey int, name string, arabic string, level string, begins timestamp, ends timestamp")
    now = R.active_at(p, "begins", "ends", "2020-02-01")
    assert sorted(r["p_partkey"] for r in now.collect()) == [1, 4]
    asked = spark.createDataFrame([(" Panadol ",), ("none",), (None,)], "n string")
    assert [(r["n"], r["p_partkey"], r["score"]) for r in K.first_priority(asked, "n", now, ["name", "arabic"]).collect()] == [(" Panadol ", 1, 1)]


def test_trigram_join_equals_all_pairs(spark):
    from linkloom.functions import similarity as Y

    r = random.Random(5)
    names = sorted({" ".join(r.choices(["red", "green", "greens", "ring", "rings", "box", "the"], k=r.randint(1, 3))) for _ in range(60)}) + ["", "zz"]
    a, b = (spark.createDataFrame([(n,) for n in names], f"{c} string") for c in "ab")
    for least in (0.3, 0.6, 1.0):
        every = a.crossJoin(b).withColumn("s", F.round(Y.trigram_similarity(F.col("a"), F.col("b")), 6)).filter(F.col("s") >= least)
        assert rows(S.trigram_matches(a, b, least)) == rows(every)


def test_holding_and_dictionary(spark):
    texts = spark.createDataFrame([(1, "want red ring of steel"), (2, ""), (3, None), (4, "ab")], "k int, t string")
    names = spark.createDataFrame([("ring",), ("ab",), ("b",), ("steel wool",), ("",), (None,)], "n string")
    assert rows(S.holding(texts, "k", "t", names, "n")) == [(1, "ring"), (4, "ab"), (4, "b")]
    m = spark.createDataFrame([("m", "ring", "red", "steel"), ("o", "zzz", "red", "steel"), ("p", "no", None, "ab")], "master string, e string, a string, i string")
    assert rows(S.dictionary_hits(texts, "k", "t", m, "master", ["e", "a", "i"])) == [(1, "m", "e"), (1, "o", "a"), (4, "p", "i")]


def test_equal_texts_are_searched_once_and_not_broadcast(spark, monkeypatch):
    whole, seen = S.holding, []
    monkeypatch.setattr(S, "holding", lambda texts, *more: (seen.append(texts.count()), whole(texts, *more))[1])
    texts = spark.createDataFrame([(i, "red ring") for i in range(40)] + [(7, "a steel pan"), (7, "a steel pan"), (99, None), (98, ""), (None, "a steel pan")], "k int, t string")
    m = spark.createDataFrame([("m", "ring", "steel"), ("o", "pan", None), ("o", "steel", "RED"), (None, "zzz", "red")], "master string, e string, a string")
    got = rows(S.dictionary_hits(texts, "k", "t", m, "master", ["e", "a"]))
    ring = [(i, x, w) for i in range(40) if i != 7 for x, w in (("m", "e"), ("o", "a"), (None, "a"))]
    assert seen == [2]  # not 45 for each of the two columns
    assert got == sorted([*ring, (7, "m", "e"), (7, "o", "e"), (7, None, "a"), (None, "m", "a"), (None, "o", "e")], key=str)
    # the texts' grams are many times the texts: a scan's size must not make a broadcast of them
    plan = whole(texts, "k", "t", m, "e")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_semantic_repeats(spark):
    v = spark.createDataFrame([(1, "a", 0, [1.0, 0.0]), (2, "a", 599, [1.0, 0.01]), (3, "a", 1201, [1.0, 0.0]), (4, "b", 600, [1.0, 0.0]), (5, "a", 600, None)], "k int, s string, t int, v array<double>")
    assert [(r[0], r[1]) for r in rows(S.semantic_repeats(v, "k", "s", "t", "v", 600, 0.95))] == [(2, 1)]


def test_rewrites_of_rows(spark):
    a = spark.createDataFrame([("x", 1, 1, 5), ("y", 2, 2, 2)], "k string, occurrences long, first_seen long, last_seen long")
    b = spark.createDataFrame([("x", 1, 7, 9), ("z", 1, 3, 3)], a.schema)
    assert rows(R.touched(a, b, "k")) == [("x", 1, 1, 9), ("y", 2, 2, 2), ("z", 1, 3, 3)]
    t = spark.createDataFrame([(1, "a", ["p"]), (2, "b", ["p", "q"])], "k int, name string, members array<string>")
    i = spark.createDataFrame([(2, "B", ["p", "p"]), (3, "c", [])], t.schema)
    assert rows(R.sync_groups(t, i, "k")) == [(1, "a", 1, "kept"), (2, "B", 1, "updated"), (3, "c", 0, "added")]
    f = R.filled_from(spark.createDataFrame([(1, "a", None), (2, "a", 9), (3, None, None)], "id int, n string, v int"), "v", F.col("n"), spark.createDataFrame([("a", 5), ("a", 4), (None, 1)], "k string, v int"))
    assert rows(f.select("id", "v")) == [(1, 4), (2, 9), (3, None)]
    assert rows(R.counted(spark.createDataFrame([(1, 0), (2, 5), (3, 1)], "k int, n long"), spark.createDataFrame([(1, -1), (2, 1), (2, 1)], "k int, step int"), "k")) == [(1, 0), (2, 7), (3, 1)]
    ids = spark.createDataFrame([(1,), (1,), (2,), (9,)], "k int")
    assert rows(R.bulk(ids, spark.createDataFrame([(1, "new"), (2, "old")], "k int, s string"), "k", F.when(F.col("s") == "old", "already old"))) == [(1, True, None), (2, False, "already old"), (9, False, "not found")]
    u = spark.createDataFrame([(1, dt.datetime(2020, 1, 1, 11, 30)), (2, dt.datetime(2020, 1, 1, 11, 29, 59)), (3, None)], "k int, a timestamp")
    assert rows(R.undone(u, "a", "2020-01-01 12:00:00").select("k", "undone")) == [(1, True), (2, False), (3, None)]


def test_decisions_and_queues(spark):
    m = spark.createDataFrame([(1, "PENDING", 0.95), (2, "PENDING", 0.5), (3, "REJECTED", 0.99)], "k int, status string, s double")
    c = R.confirmed(m, F.col("k") == 1, "CONFIRMED", "2020-01-01", F.lit(""))
    assert [(r["k"], r["status"], r["confirmed_at"] is not None, r["matched_by"]) for r in c.orderBy("k").collect()] == [(1, "CONFIRMED", True, None), (2, "PENDING", False, None), (3, "REJECTED", False, None)]
    changed, feedback = R.auto_confirmed(m, F.col("s") >= 0.9, "2020-01-01")
    assert [(r["k"], r["matched_by"]) for r in changed.collect()] == [(1, "auto")] and [(r["k"], r["confirmed"]) for r in feedback.collect()] == [(1, True)]
    t = dt.datetime(2020, 1, 1)
    q = spark.createDataFrame([(1, "PENDING", 3, t, t, 2), (2, "PENDING", 9, t, t, 0), (3, "PENDING", 9, t, t + dt.timedelta(days=9), 0), (4, "FAILED", 9, t, t, 3)], "id int, status string, priority int, created_at timestamp_ntz, next_at timestamp_ntz, attempts int")
    assert [r["id"] for r in R.dequeued(q, "2020-01-02", 5).collect()] == [2, 1]
    assert [(r["id"], r["attempts"], r["status"]) for r in R.failed(q.filter("id < 3"), "2020-01-02").orderBy("id").collect()] == [(1, 3, "FAILED"), (2, 1, "PENDING")]
    with pytest.raises(ValueError):
        R.sort_by("drop table", "asc", ["a"], "id")


def test_audit_filter_and_status(spark):
    a = spark.createDataFrame([(1, "x", dt.datetime(2020, 1, 1), None, True, 7), (2, "x", dt.datetime(2020, 1, 2), 0.5, False, None)], "match_id int, event_type string, ts timestamp, confidence double, overridden boolean, override_by int")
    k = lambda **kw: sorted(r["match_id"] for r in R.audit_filter(a, **kw).collect())
    assert k() == [1, 2] and k(min_confidence=0.1) == [2] and k(max_confidence=0.9) == [2] and k(start="2020-01-02", end="2020-01-02") == [2] and k(overridden=True, override_by=7) == [1]
    s = spark.createDataFrame([(dt.datetime(2020, 1, 1), None), (None, None), (dt.datetime(2020, 1, 1), "e")], "p timestamp, e string")
    assert sorted(r[0] for r in s.select(R.status_of(F.col("p"), F.col("e"))).collect()) == ["Error", "Processed", "Unprocessed"]


def test_folds_hold_a_key_at_a_time(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 9), ("b", 5)], "k string, i int")
    from pyspark.sql import types as Ty

    got = folds.folded(df, ["k"], ["i"], ["i"], [Ty.StructField("s", Ty.LongType())], lambda: 0, lambda s, i: (s + i, (s + i,)))
    assert rows(got) == sorted([(None, 1, 1), (None, 3, 4), ("a", 2, 2), ("a", 9, 11), ("b", 5, 5)], key=str)
    assert folds.folded(df.limit(0), ["k"], ["i"], ["i"], [Ty.StructField("s", Ty.LongType())], lambda: 0, lambda s, i: (s, (s,))).count() == 0


def test_affinity_composes_over_days(spark):
    r = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    data = [(r.choice("ab"), i, t0 + dt.timedelta(hours=r.randint(0, 200)), r.random() < 0.6) for i in range(300)]
    got = {x["k"]: x["affinity"] for x in L.affinity(spark.createDataFrame(data, "k string, i int, ts timestamp, ok boolean"), ["k"], "ts", "i", F.col("ok")).collect()}
    for k in "ab":
        a = 0.5
        for _, _, ok in sorted((t, i, ok) for c, i, t, ok in data if c == k):
            a = min(1.0, a + 0.1) if ok else max(0.0, a - 0.15)
        assert got[k] == pytest.approx(a)


def test_ranked_values_without_sorting_keys(spark):
    r = random.Random(3)
    data = [("a", r.gauss(0, 5)) for _ in range(999)] + [("b", 7.0)] * 500 + [("b", float(i)) for i in range(20)] + [("c", 1.0), ("a", None), (None, 4.0), (None, 5.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {x["k"]: (x["p50"], x["p95"]) for x in Q.ranked_values(df.filter("k IS NOT NULL"), ["k"], "v", {"p50": 0.5, "p95": 0.95}, buckets=16).collect()}
    for k in "abc":
        v = sorted(x for c, x in data if c == k and x is not None)
        half_up = lambda x: int(x + 0.5)
        assert got[k] == (v[half_up((len(v) - 1) * 0.5)], v[half_up((len(v) - 1) * 0.95)])


def test_histogram_quantile_and_empty_dashboards(spark):
    h = lambda q, n, *c: spark.range(1).select(Q.histogram_quantile(q, F.lit(n), [F.lit(x) for x in c], (1.0, 2.0, 4.0))).first()[0]
    assert h(0.5, 10, 0, 10, 10) == 1.5 and h(0.5, 10, 5, 10, 10) == 1.0 and h(0.99, 10, 0, 0, 1) == 4.0
    none = spark.createDataFrame([], "action string, confidence double, o boolean")
    assert tuple(Q.approvals(none, "action", "confidence", "o").first()) == (0, 0, 0, 0.0, 0.0)
    assert tuple(L.affinity_stats(spark.createDataFrame([], "n long, confirmed long, affinity double")).first()) == (0, 0, 0.5, 0, 0)
    assert Q.errors(spark.createDataFrame([(None,)], "m string"), "m", 5).count() == 0


def test_gates(spark):
    m = lambda c, r, rate: F.struct(F.lit(c).alias("avg_confirmed"), F.lit(r).alias("avg_rejected"), F.lit(rate).alias("rate"))
    old = m(0.8, 0.5, 0.7)
    assert tuple(spark.range(1).select(L.should_apply(old, m(0.9, 0.5, 0.66)), L.should_apply(old, m(0.9, 0.5, 0.6)), L.should_apply(old, m(0.8, 0.5, 0.9))).first()) == (True, False, False)
    arm = lambda n, k: F.struct(F.lit(n).alias("n"), F.lit(k).alias("confirmed"), F.lit(n - k).alias("rejected"))
    got = spark.range(1).select(*[L.test_decision(arm(n, a), arm(n, b)) for n, a, b in ((40, 20, 40), (500, 250, 350), (500, 350, 250), (500, 250, 255))]).first()
    assert tuple(got) == ("Continue", "Promote", "Rollback", "Continue")
    users = spark.range(2000).select(L.arm_of(F.col("id"), "t", 0.25).alias("a"), L.arm_of(F.col("id"), "u", 0.25).alias("b"))
    n = users.agg(F.count_if(F.col("a") == "test"), F.count_if(F.col("a") == F.col("b"))).first()
    assert 400 < n[0] < 600 and n[1] < 1500


def test_strategies_plug_in(spark):
    class Fixed:
        def __init__(self, name, value, weight):
            self.name, self.value, self.weight = name, value, weight

        def score(self):
            return F.lit(self.value)

    s = spark.range(1).select(K.plugged([Fixed("a", 1.0, 0.5), Fixed("b", 0.0, 0.5), Fixed("off", 9.0, 0.0)]).alias("s")).select("s.*").first()
    assert tuple(s) == (0.5, "a", "b")


def test_sinks_and_guards(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    m = spark.createDataFrame([("k", i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 6, 7, 20])], "k string, i int, ts timestamp")
    assert [r["batch"] for r in I.micro_batches(m, ["k"], "ts", "i", most=3, seconds=5).orderBy("i").collect()] == [0, 0, 0, 1, 1, 2]
    assert [r["allowed"] for r in I.history_guard(m, ["k"], "ts", "i", cooldown=6).orderBy("i").collect()] == [True, False, False, True, False, True]
    assert sorted(r["i"] for r in I.backfill(m, ["k"], "ts", "i", F.lit("2024-01-01 00:00:20").cast("timestamp"), 1, 2).collect()) == [4, 5]
    tries = []

    def send(batch):
        tries.append(batch.count())
        if len(tries) < 3:
            raise OSError("down")

    I.delivered(send, f"{tmp_path}/dead")(m, 1, f"{tmp_path}/out")
    assert tries == [6, 6, 6] and spark.read.parquet(f"{tmp_path}/out").count() == 6

    def never(batch):
        raise OSError("down")

    I.delivered(never, f"{tmp_path}/dead")(m, 2, f"{tmp_path}/out")
    assert {(r["error"], r["attempts"]) for r in spark.read.parquet(f"{tmp_path}/dead").collect()} == {("OSError: down", 3)}
    I.fan_out({"late": F.col("i") > 3, "none": F.lit(False)})(m, 0, f"{tmp_path}/fan")
    assert spark.read.parquet(f"{tmp_path}/fan/late-0").count() == 2 and spark.read.parquet(f"{tmp_path}/fan/none-0").count() == 0
    h = 0
    for b in "group-é".encode():
        h = (31 * h + b) & 0x7FFFFFFF
    assert spark.range(1).select(I.shard(F.lit("group-é"), 7), I.shard(F.lit(""), 7)).first()[:] == (h % 7, 0)


def test_polling_stream(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "k int").write.parquet(f"{tmp_path}/in/x.parquet")
    s = spark.readStream.schema("k int").parquet(f"{tmp_path}/in/x.parquet")
    assert sorted(r["k"] for r in I.drained(s, "append", every="1 second", seconds=6).collect()) == [1, 2]


def test_seeds_storage_plans_and_metrics(spark, tmp_path):
    meds = [{"canonical_name": "A", "strength": "5", "aliases": ["a1", "a2"]}, {"canonical_name": "B"}]
    (tmp_path / "seed.json").write_text(json.dumps({"version": "1", "description": "d", "medications": meds}, indent=1))
    masters, aliases = T.seed(spark, f"{tmp_path}/seed.json")
    assert rows(masters.select("canonical_name", "strength")) == [("A", "5"), ("B", None)] and rows(aliases) == [("A", "a1"), ("A", "a2")]
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    s = T.storage_of(df, "t").first()
    assert (s["table_name"], s["files"]) == ("t", 2) and s["bytes"] > 100
    p = T.plan_summary(df.filter("id > 3").join(df.withColumnRenamed("id", "j"), F.col("id") == F.col("j")))
    assert p["joins"] == 1 and p["scans"] >= 1 and p["nested_loops"] == 0
    assert T.plan_summary(df)["whole_scans"] == 1 and T.plan_summary(df.filter("id > 3"))["whole_scans"] == 0
    out, seen = Q.observed(df, "m", {"n": F.count("*"), "most": F.max("id")})
    out.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 10, "most": 9}
    assert T.preview(df, 3).count() == 3


def test_exact_repeats_over_micro_batches(spark, tmp_path):
    import time

    t0, schema = dt.datetime(2024, 1, 1), "s string, i int, ts timestamp"
    for n, part in enumerate(([("a", 0, 0), ("a", 1, 9), ("b", 2, 9)], [("a", 4, 13), ("a", 3, 12), ("b", 5, 18), ("a", 6, 22)])):
        spark.createDataFrame([(s, i, t0 + dt.timedelta(seconds=x)) for s, i, x in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/x{n}")
        time.sleep(1.1)  # batches go by the files' times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = I.with_state(spark, lambda: I.drained(I.marked_repeats(stream, "s", "s", "ts", "i"), "append"))
    assert [r["duplicate"] for r in got.orderBy("i").collect()] == [False, True, False, False, True, True, False]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
