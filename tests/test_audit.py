"""Audit records and example pools on small rows, against plain versions."""

import random

from pyspark.sql import functions as F

from linkloom.operators import audit as A


def test_stage_rows_and_sections(spark):
    good = '{"match_id": 1, "final_score": 0.5, "pipeline_stages": [{"stage": "parsing", "started_at": "2024-01-01T00:00:00Z", "duration_ms": 7, "details": {"a": 1}}, {"stage": "x", "duration_ms": 2}, {"stage": "x", "duration_ms": 3}], "ai_record": {"latency_ms": 9}}'
    df = spark.createDataFrame([(good, "k"), (None, "n"), ("broken", "b"), ('{"match_id": 2}', "e")], "record string, final_score string")
    rows = A.stage_rows(df, "record").orderBy("nth").collect()
    assert [(r["match_id"], r["stage"], r["involves_ai"], r["details"]) for r in rows] == [(1, "parsing", True, '{"a":1}'), (1, "x", False, None), (1, "x", False, None)]
    assert (rows[0]["completed_at"] - rows[0]["started_at"]).microseconds == 7000 and rows[1]["completed_at"] is None
    got = {r["match_id"]: r for r in A.sections(df, "record").collect()}
    assert got[1]["ai_ms"] == 9 and got[1]["stage_ms"] == {"parsing": 7, "x": 3} and got[1]["final_score"] == 0.5
    assert got[2]["stage_ms"] is None and len(got) == 3
    assert A.stage_rows(df.limit(0), "record").count() == 0


def test_alike():
    assert A.alike("abc", "abcdef") and A.alike("", "x") and not A.alike("abc", "abd")
    assert not A.alike("a" * 20, "a" * 70) and A.alike("a" * 20 + "b", "a" * 20 + "c")
    assert not A.alike("é" * 25, "é" * 50)


def test_example_pool_against_a_plain_fold(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), i, r.choice("pqrstuv") * r.randint(1, 3), r.randint(1, 3), r.randint(0, 2)) for i in range(120)]
    want = {}
    for c, i, text, n, u in rows:
        pool = want.setdefault(c, [])
        for e in pool:
            if A.alike(e[1], text):
                e[2] += 1
                break
        else:
            if len(pool) == 4:
                worst = min(pool, key=lambda e: (e[2], e[3]))
                pool[pool.index(worst)] = [i, text, n, u]
            else:
                pool.append([i, text, n, u])
    df = spark.createDataFrame(rows + [(None, 500, "z", 1, 1), ("a", 501, None, 1, 1)], "c string, i long, t string, n long, u long")
    got = A.example_pool(df, "c", ["i"], "t", F.col("n"), F.col("u"), 4).orderBy("c", "place").collect()
    assert [(x["c"], x["i"], x["t"], x["confirmations"], x["usage"]) for x in got] == [(c, *e) for c in "ab" for e in want[c]]
    assert A.example_pool(df, "c", ["i"], "t", F.col("n"), F.col("u"), 0).count() == 0
