"""Thresholds, breakers, resolving and fallbacks against plain versions on small rows."""

import random

from pyspark.sql import functions as F

from linkloom.operators import adaptive as A
from linkloom.operators import linkage as K


def test_threshold_levels_are_closed():
    levels, lower, higher = A.threshold_levels(0.70, 0.02, 0.30, 0.95)
    assert levels[0] == 0.30 and levels[-1] == 0.95 and 0.93 in levels
    assert levels[higher[levels.index(0.94)]] == 0.95 and levels[lower[levels.index(0.95)]] == 0.93
    assert lower[0] == 0 and higher[-1] == len(levels) - 1


def test_adaptive_thresholds(spark):
    rng = random.Random(3)
    rows = [(k, i, None if i % 17 == 0 else round(rng.random(), 3)) for k in ("a", "b") for i in range(95 if k == "b" else 430)]
    got = {(r["key"], r["window"]): r for r in A.adaptive_thresholds(spark.createDataFrame(rows, "key string, i int, s double"), ["key"], ["i"], "s", window=20).collect()}
    for k in ("a", "b"):
        scores, at = [s for key, _, s in rows if key == k], 0.70
        for w in range(-(-len(scores) // 20)):
            part = scores[20 * w : 20 * w + 20]
            n = sum(s is not None and s >= at for s in part)
            assert (got[k, w]["threshold"], got[k, w]["accepted"], got[k, w]["total"]) == (at, n, len(part))
            if len(part) == 20:
                at = round(min(0.95, max(0.30, at + (-0.02 if n / 20 < 0.80 else 0.02 if n / 20 > 0.90 else 0))), 9)
            assert got[k, w]["next"] == at


def test_circuit_opens_and_closes(spark):
    rows = [("k", float(t), ok) for t, ok in ((0, False), (1, False), (2, False), (3, True), (33, False), (40, True), (64, True), (65, True))]
    got = A.circuit_states(spark.createDataFrame(rows, "key string, t double, ok boolean"), ["key"], ["t"], "t", "ok").orderBy("t").collect()
    assert [r["allowed"] for r in got] == [True, True, True, False, True, False, True, True]
    assert [r["state"] for r in got] == ["closed", "closed", "open", "open", "open", "open", "closed", "closed"]


def test_uncertainty_is_repeatable_and_centred(spark):
    df = spark.range(400).select("id", A.uncertainty(F.col("id"), {"a": F.lit(0.8), "b": F.lit(0.2)}, {"a": 0.6, "b": 0.4}, samples=40).alias("u"))
    one, two = df.select("id", "u.*").orderBy("id").collect(), df.select("id", "u.*").orderBy("id").collect()
    assert one == two
    assert abs(sum(r["mean"] for r in one) / 400 - 0.56) < 0.003
    assert all(r["low"] <= r["mean"] <= r["high"] and r["certain"] and abs(r["original"] - 0.56) < 1e-9 for r in one)


def test_decay_and_bonus(spark):
    rows = spark.createDataFrame([(0.8, 10, 3, 5), (0.8, 50, 3, 5), (0.1, 5, 0, 5), (0.9, 91, 9, 9), (0.7, 0, 1, 9), (0.2, 0, 0, 9)], "s double, d int, c int, n int")
    got = rows.select(F.round(A.decayed_affinity(F.col("s"), F.col("d")), 6), F.round(A.historical_bonus(F.col("s"), F.col("c"), F.col("n")), 6)).collect()
    assert [tuple(r) for r in got] == [(0.7, 0.06), (0.5, 0.06), (0.15, -0.08), (0.5, 0.08), (0.7, 0.0), (0.2, -0.06)]


def test_resolver_order_and_short_names(spark):
    names = spark.createDataFrame([("pan",), ("panadol",), ("panadol extra",), ("brufe",), ("zz",), ("b",), (None,)], "name string")
    aliases = spark.createDataFrame([("pan", 7), (None, 8)], "alias string, master int")
    masters = spark.createDataFrame([(1, "panadol"), (2, "panadol extr"), (3, "brufen"), (4, "b2")], "master int, canonical string")
    semantic = spark.createDataFrame([("zz", 3, 0.75), ("zz", 2, 0.93), ("pan", 3, 0.99)], "name string, master int, score double")
    got = {r["name"]: (r["master"], r["method"], r["approved"]) for r in K.resolve(names, aliases, masters, semantic=semantic).collect()}
    assert got == {"pan": (7, "alias", True), "panadol": (1, "master", True), "panadol extra": (None, None, None), "brufe": (3, "fuzzy", False), "zz": (2, "semantic", True), "b": (None, None, None)}


def test_fallback_strategies(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0.0), (2, 1, 2, 0.95), (3, 1, 2, 0.2), (4, None, 2, 0.75)], "id int, a int, b int, s double")
    s = F.col("s")
    m = rows.withColumn("match", K.fallback_match((F.col("a"), F.col("b")), (F.lit(0.9), F.lit(0.7)), s == 1, s, s, embedding=F.when(F.col("id") == 3, 0.85)))
    assert {r["id"]: r["match"]["method"] for r in K.by_strategy(m, "embeddings").collect()} == {1: "same_master", 2: "fuzzy", 3: "embedding", 4: "fuzzy"}
    assert K.by_strategy(m, "reject").count() == 0
    assert {r["match"]["score"] for r in K.by_strategy(m, "queue").collect()} == {0.0}


def test_learned_aliases_need_one_known_side(spark):
    rows = [(0.9, "Panadol", "Pnadol", 1, None), (0.9, "pnadol", "Panadol", None, 1), (0.9, "x", "y", 1, 2), (0.8, "Panadol", "q", 1, None), (0.9, "Panadol", "q", 1, None)]
    df = spark.createDataFrame(rows, "s double, o string, r string, om int, rm int")
    got = A.learned_aliases(df, "s", "o", "r", "om", "rm").collect()
    assert [(r["alias"], r["master"], r["confirmations"]) for r in got] == [("pnadol", 1, 2)]
