"""Audit records of matches, kept as JSON: typed sections, a row per stage; and pools of prompt examples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields of a stored record.
STAGE = "stage string, started_at timestamp, duration_ms bigint, candidates_in bigint, candidates_out bigint, details string"
RECORD = f"match_id bigint, final_score double, total_latency_ms bigint, ai_involved boolean, resolution_stage string, pipeline_stages array<struct<{STAGE}>>, ai_record struct<model string, latency_ms bigint>"


def sections(df: DataFrame, json: str) -> DataFrame:
    """df without the JSON, with the record's typed fields, ai_ms and stage_ms (map of stage to its last duration).

    Broken or null JSON gives null fields; a column of df with a field's name is replaced.
    """
    new = ["match_id", "final_score", "total_latency_ms", "ai_involved", "resolution_stage"]
    r = F.from_json(json, RECORD)
    out = df.withColumn("__r", r)
    last = F.aggregate(
        F.col("__r.pipeline_stages"), F.create_map().cast("map<string,bigint>"),
        lambda m, s: F.when(s["stage"].isNull(), m).otherwise(F.map_concat(F.map_filter(m, lambda k, _: k != s["stage"]), F.create_map(s["stage"], s["duration_ms"]))),
    )
    stages = F.col("__r.pipeline_stages")
    return out.withColumns({c: F.col(f"__r.{c}") for c in new} | {"ai_ms": F.col("__r.ai_record.latency_ms"), "stages": stages, "stage_ms": last}).drop("__r", json)


def selected(df: DataFrame, min_score: float | None = None, ai_involved: bool | None = None) -> DataFrame:
    """The sections of records that meet the filters that are given; a null score meets none."""
    out = df if min_score is None else df.filter(F.col("final_score") >= min_score)
    return out if ai_involved is None else out.filter(F.coalesce("ai_involved", F.lit(False)) == ai_involved)


def stage_rows(df: DataFrame, json: str) -> DataFrame:
    """A row per stage of each record: match_id, nth, its fields, completed_at and involves_ai; records without stages give none."""
    flat = df.select(F.from_json(json, RECORD).alias("r")).select("r.match_id", F.posexplode("r.pipeline_stages").alias("nth", "s"))
    end = F.timestamp_millis(F.unix_millis("s.started_at") + F.col("s.duration_ms"))
    name = F.col("s.stage")
    return flat.select("match_id", "nth", "s.*", end.alias("completed_at"), (name.contains("ai") | name.contains("parsing")).alias("involves_ai"))


def alike(a: str, b: str) -> bool:
    """Byte lengths within 49, and equal first characters: 20, or all of the shorter text."""
    n = min(20, len(a), len(b))
    return abs(len(a.encode()) - len(b.encode())) < 50 and a[:n] == b[:n]


def example_pool(df: DataFrame, category: str, order: list[str], text: str, confirmations: Column, usage: Column, most: int) -> DataFrame:
    """(category, place, order columns, text, confirmations, usage): what each category's pool of `most` holds in the end.

    In the given order, an example like one in the pool confirms that one, else takes a free place, else the place
    with the least (confirmations, usage), the first of equals. Order matters, so a category is one sorted run of a
    task; it is read batch by batch and only the pool is held. Null categories and null texts are left out.
    """
    src = df.filter(F.col(category).isNotNull() & F.col(text).isNotNull()).select(category, *order, text, confirmations.cast("long").alias("confirmations"), usage.cast("long").alias("usage"))
    names = [category, "place", *order, text, "confirmations", "usage"]
    schema = T.StructType([src.schema[category], T.StructField("place", T.IntegerType()), *[src.schema[c] for c in [*order, text, "confirmations", "usage"]]])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pool = None, []
        done = lambda: pd.DataFrame([[r[0], k, *r[1:]] for k, r in enumerate(pool, 1)], columns=names)
        for b in batches:
            for row in b.itertuples(index=False, name=None):
                if row[0] != now:
                    if pool:
                        yield done()
                    now, pool = row[0], []
                like = next((r for r in pool if alike(r[-3], row[-3])), None)
                if like:
                    like[-2] += 1
                elif len(pool) < most:
                    pool.append(list(row))
                elif pool:
                    k = min(range(len(pool)), key=lambda i: (pool[i][-2], pool[i][-1]))
                    pool[k] = list(row)
        if pool:
            yield done()

    return src.repartition(category).sortWithinPartitions(category, *order).mapInPandas(fold, schema)
