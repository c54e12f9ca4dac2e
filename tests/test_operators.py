"""Operators on small frames: nulls, ties, empties; and the registry's shape."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkloom.functions import splitting
from linkloom.operators import learning as L
from linkloom.operators import linkage as K
from linkloom.operators import quality as Q
from linkloom.operators import relational as R
from linkloom.operators import search as S
from linkloom.plans import QUERIES
from linkloom.sources import tables as T
from linkloom.streaming import ingest as I


def test_registry_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_smoke_entry(spark):
    assert entry.entry(spark).count() > 0


def test_quality(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, "x")], "k int, s string")
    assert {(r.column_name, r.nulls, r.verdict) for r in Q.null_profile(df, "t").collect()} == {("k", 0, "No Nulls"), ("s", 1, "Review")}
    assert Q.empty_profile(df, "t", ["s"]).first().empty_count == 2
    r = Q.orphans(df, "s", spark.createDataFrame([("x",)], "p string"), "p", "r").first()
    assert (r.refs, r.orphans, r.orphan_pct) == (2, 1, 50.0)
    lat = Q.latency(spark.createDataFrame([("a", 10 * i) for i in range(1, 11)], "g string, v long"), ["g"], "v").first()
    assert (lat["mean"], lat["median"], lat["p95"], lat["p99"]) == (55.0, 55, 100, 100)
    assert Q.latency(df.limit(0).select("k"), [], "k").first()["n"] == 0


def test_rewrites(spark):
    old = spark.createDataFrame([("a", 1, 1, 1)], "alias string, occurrences long, first_seen long, last_seen long")
    new = spark.createDataFrame([("a", 5, 3, 9), ("b", 2, 2, 2)], old.schema)
    assert sorted(map(tuple, R.upsert_counts(old, new, "alias").collect())) == [("a", 5, 1, 9), ("b", 2, 2, 2)]
    assert R.insert_missing(old, new, "alias").count() == 2
    with pytest.raises(ValueError):
        R.page(old, [F.asc("alias")], 101)
    kept = R.retained(spark.createDataFrame([(dt.datetime(2020, 1, 1),), (None,)], "t timestamp"), "t", "2021-01-01", 30)
    assert kept.count() == 1
    assert R.either(new, "alias", spark.createDataFrame([("b",)], "x string"), spark.createDataFrame([("b",), ("c",)], "y string")).count() == 1


def test_learning(spark):
    ev = spark.createDataFrame([("k", i, ok) for i, ok in enumerate([True] * 6 + [False] * 2)], "k string, t int, ok boolean")
    assert L.affinity(ev, ["k"], "t", "t", F.col("ok")).first().affinity == pytest.approx(0.7)
    b = L.bins(spark.createDataFrame([(0.3, True), (1.0, True), (0.29, False)], "s double, ok boolean"), F.col("s"), F.col("ok"))
    assert {r.bin: r.n for r in b.collect()} == {2: 1, 3: 1, 9: 1} or {r.bin: r.n for r in b.collect()} == {2: 2, 9: 1}
    vals = [1.0, 2.0] * 15 + [50.0, 1.0]
    o = L.outliers(spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "g int, i int, v double"), ["g"], ["i"], "v")
    assert [r.i for r in o.filter("outlier").collect()] == [30]
    runs = L.runs(spark.createDataFrame([(1, i, x) for i, x in enumerate([1, 1, 0, 1])], "g int, i int, x int"), ["g"], ["i"], F.col("x") == 1)
    assert [r.run for r in runs.orderBy("i").collect()] == [1, 2, 0, 1]
    t = L.token_batches(spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 5, 100, 1])], "g int, i int, n int"), ["g"], ["i"], "n", budget=10)
    assert [r.batch for r in t.orderBy("i").collect()] == [0, 0, 1, 2]


def test_linkage(spark):
    pairs = spark.createDataFrame([(1, 1, True, 0.1, 0.1), (1, 2, False, 0.9, 0.9), (2, 3, False, 0.9, 0.8), (2, 4, False, None, 0.8), (3, 5, False, None, 0.8), (4, 6, False, None, 0.2)], "q int, o int, m boolean, e double, f double")
    got = {(r.q, r.o): (r.stage, round(r.score, 4)) for r in K.cascade(pairs, "q", F.col("m"), F.col("e"), F.col("f")).collect()}
    assert got == {(1, 1): (1, 1.0), (2, 3): (2, 0.84), (3, 5): (3, 0.8)}
    d = spark.range(1).select(K.class_mismatch(F.lit("a"), F.lit("b"), F.lit(0.85)).alias("x"), K.class_mismatch(F.lit("a"), F.lit(None), F.lit(0.85)).alias("y"), K.decision(F.lit(False), F.lit(False), F.lit(0.9), F.lit(0.9)).alias("z"), K.retry_route(F.lit("Timeout x")).alias("r")).first()
    assert tuple(d) == (True, False, "Approved", "retry_later")


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "red red fox"), (3, None), (4, "")], "id int, text string")
    got = S.bm25(docs, "id", "text", spark.createDataFrame([(9, "fox red")], "q int, t string"), "q", "t", 5, cut=0.0).collect()
    assert S.bm25(docs, "id", "text", spark.createDataFrame([(9, "fox red")], "q int, t string"), "q", "t", 5).count() == 0 and all(r.score < 0 for r in got)
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [2, 1]
    parts = [("a", spark.createDataFrame([(1, 5, 0.5)], "g int, id int, score double")), ("b", spark.createDataFrame([(1, 5, 0.9), (1, 6, 0.7)], "g int, id int, score double"))]
    assert {(r.id, r.method, r.score) for r in S.fuse(parts, ["id"], 5, "g").collect()} == {(5, "a", 0.5), (6, "b", 0.7)}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, s string")
    T.write_csv(df, f"{tmp_path}/c")
    T.write_json(df, f"{tmp_path}/j")
    for back in (T.read_csv(spark, f"{tmp_path}/c", df.schema), T.read_json(spark, f"{tmp_path}/j", df.schema)):
        assert sorted(map(tuple, back.collect())) == [(1, "a,b"), (2, None)]
    (tmp_path / "d.json").write_text('{"x": {"english": "X", "synonyms": ["p", "q"]}, "y": {"english": "Y", "synonyms": []}}')
    assert sorted(map(tuple, T.dictionary(spark, f"{tmp_path}/d.json").fillna("").collect())) == [("x", "X", "p"), ("x", "X", "q"), ("y", "Y", "")]
    assert "Scan" in T.plan_of(T.read_csv(spark, f"{tmp_path}/c", df.schema))


def test_streams(spark):
    assert I.replayed([0.0, 9.0, 10.0, 12.0], None, 10.0) == ([False, True, False, True], 10.0)
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 0, 0, 60])], "k int, i int, ts timestamp")
    got = I.rate_limited(df, ["k"], "ts", "i", per_minute=1, burst=2).orderBy("i").collect()
    assert [r.allowed for r in got] == [True, True, False, True]
    m = spark.createDataFrame([("a@g.us", False, "x"), ("b@c", False, "x"), ("a@g.us", True, "x"), ("a@g.us", False, " ")], "group_jid string, is_from_me boolean, content string")
    assert I.guarded(m).count() == 1


def by_hand(text):
    """(number, intent, marker, segment), letter by letter."""
    marks = []
    for pattern, intent in ((splitting.OFFER, "Offer"), (splitting.REQUEST, "Request")):
        at = 0
        while at < len(text):
            m = pattern.match(text, at)
            marks += [(at, m.end(), intent)] if m else []
            at = m.end() if m else at + 1
    if not marks:
        return [(0, "Unknown", None, text)]
    out, intent, marker, start = [], "Unknown", None, 0
    for at, end, after in [*sorted(marks), (len(text), len(text), None)]:
        if text[start:at].strip():
            out.append((len(out), intent, marker, text[start:at].strip()))
        start, intent, marker = end, after, text[at:end].strip()
    return out


def test_intent_segments_of_all_messages(spark, tmp_path):
    texts = ["hello available panadol need aspirin", "I have x for sale", "plain", "", None, "مطلوب دواء متوفر بندول", "behave kneed", "we need\nneed it\n\nselling two looking for one", " wanted ", "  untouched  "]
    spark.createDataFrame([(i, 0, "user", x) for i, x in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, QUERIES["intent_split"](spark, str(tmp_path)).collect()))
    assert got == [(i, 0, *r) for i, x in enumerate(texts) for r in by_hand(x or "")]
    assert {r[3] for r in got} == {"Offer", "Request", "Unknown"}


def test_nearest_in_blocks_equals_all_pairs(spark):
    rows = [(i, [float((i * j * j + i) % 7 - 3) for j in range(1, 5)]) for i in range(90)] + [(100, [0.0] * 4), (101, None), (120, [1.0]), (140, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 20 = 0")
    want = sorted(map(tuple, S.nearest(v, q, 5).collect()))
    assert {r[0] for r in want} == {0, 20, 40, 60, 80, 100}
    for size in (4096, 25, 3):
        assert sorted(map(tuple, S.nearest_in_blocks(v, q, 5, size).collect())) == want
    g = v.withColumn("g", F.when(F.col("vec_id") % 7 > 0, F.col("vec_id") % 2))  # null values of a block meet nothing
    want = sorted(map(tuple, S.nearest(g, g.filter("vec_id % 20 = 0"), 3, 0.0, ["g"]).collect()))
    assert len(want) > 5 and all(sorted(map(tuple, S.nearest_in_blocks(g.filter("g IS NOT NULL"), g.filter("g IS NOT NULL AND vec_id % 20 = 0"), 3, size, 0.0, ["g"]).collect())) == want for size in (4096, 10))
    one = spark.createDataFrame([(20, [1.0, 0.0])], v.schema)
    assert S.nearest_in_blocks(one, one, 5).count() == 0


def test_pairs_of_all_lines_are_probed(spark, tmp_path):
    spark.createDataFrame([(1, 7, 3, 1), (1, 9, 4, 2), (2, 3, 7, 2)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(104, 9, dt.datetime(1995, 6, 1)), (103, 7, dt.datetime(1994, 1, 1))], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, QUERIES["pair_cooldowns"](spark, str(tmp_path)).collect())) == [(3, 7, False), (4, 9, True)]
