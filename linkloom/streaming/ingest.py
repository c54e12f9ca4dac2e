"""Message ingest as Structured Streaming: guards, deduplication, rate limits, windows and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkloom.operators.folds import folded
from linkloom.operators.relational import top_k
from linkloom.session import forget_at_exit, shared_dir


def source(spark: SparkSession, folder: str, schema: T.StructType, name: str, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of one name in a folder; `files` a batch is the back-pressure."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)


def guarded(df: DataFrame, monitored: DataFrame | None = None, now: Column | None = None, most_hours: int = 24) -> DataFrame:
    """Group messages of others that have text, of monitored groups, not older than so many hours before `now`."""
    out = df.filter(F.col("group_jid").endswith("@g.us") & ~F.col("is_from_me") & (F.trim("content") != ""))
    if now is not None:
        out = out.filter(F.col("timestamp") >= now - F.expr(f"interval {most_hours} hours"))
    return out.join(monitored.select("group_jid"), "group_jid", "left_semi") if monitored is not None else out


def replayed(times: list[float], recorded: float | None, window: float) -> tuple[list[bool], float | None]:
    """Which of a key's messages repeat the recorded one, less than `window` seconds from it; others are recorded in its place."""
    out = []
    for t in times:
        dup = recorded is not None and abs(t - recorded) < window
        if not dup:
            recorded = t
        out.append(dup)
    return out, recorded


def deduplicated(df: DataFrame, sender: str, content: str, at: str, window: str = "10 seconds") -> DataFrame:
    """A stream without repeats: the same sender and content within the watermark's delay, whatever the group.

    State is one entry a key and goes as the watermark passes it; entries aren't renewed by repeats.
    """
    marked = df.withWatermark(at, window).withColumn("__key", F.sha2(F.concat_ws(":", F.col(sender).cast("string"), F.col(content)), 256))
    return marked.dropDuplicatesWithinWatermark(["__key"]).drop("__key")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Recorded(StatefulProcessor):
    """Marks a key's messages that are less than `window` seconds from the recorded one, which repeats don't renew."""

    def __init__(self, key: str, columns: list[str], at: str, tie: str, window: float) -> None:
        self.key, self.columns, self.at, self.tie, self.window = key, columns, at, tie, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("recorded", "us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        batch = pd.concat(list(rows)).sort_values([self.at, self.tie], kind="stable")  # a key's messages of one micro-batch
        recorded = self.last.get()[0] / 1e6 if self.last.exists() else None
        flags, recorded = replayed([us / 1e6 for us in batch[self.at]], recorded, self.window)
        self.last.update((round(recorded * 1e6),))
        yield batch[self.columns].assign(duplicate=flags)

    def close(self) -> None:
        pass


def marked_repeats(df: DataFrame, sender: str, content: str, at: str, tie: str, window: float = 10.0) -> DataFrame:
    """A stream with duplicate, by the exact rule, whatever the group: state is the recorded time of each sender and content.

    Within a micro-batch messages go in order of time. Needs the RocksDB state store (with_state).
    """
    us = df.withColumns({"us__": F.unix_micros(F.col(at).cast("timestamp")), "key__": F.sha2(F.concat_ws(":", F.col(sender).cast("string"), F.col(content)), 256)})
    schema = T.StructType([*df.schema.fields, T.StructField("duplicate", T.BooleanType())])
    return us.groupBy("key__").transformWithStateInPandas(statefulProcessor=Recorded("key__", df.columns, "us__", tie, window), outputStructType=schema, outputMode="Append", timeMode="None")


def with_state(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """run(), with the RocksDB state store for the streams it starts and ends; the session's setting is as before then."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(name, before)


def replay_duplicates(df: DataFrame, sender: str, content: str, at: str, tie: str, window: float = 10.0) -> DataFrame:
    """df with duplicate, by the exact rule over a finished log: a message less than `window` seconds from the last recorded one of its sender and content."""
    us = df.withColumn("us__", F.unix_micros(F.col(at).cast("timestamp")))

    def step(recorded: int | None, t: int) -> tuple[int | None, tuple[bool]]:
        flags, last = replayed([t / 1e6], None if recorded is None else recorded / 1e6, window)
        return (recorded if flags[0] else t), (flags[0],)

    return folded(us, [sender, content], [at, tie], ["us__"], [T.StructField("duplicate", T.BooleanType())], lambda: None, step).drop("us__")


def rate_limited(df: DataFrame, keys: list[str], at: str, tie: str, per_minute: float = 1000.0, burst: float = 100.0) -> DataFrame:
    """df with allowed: a token bucket of each key in order of time."""
    us = df.withColumn("us__", F.unix_micros(F.col(at).cast("timestamp")))

    def step(state: tuple[float, int | None], t: int) -> tuple[tuple[float, int | None], tuple[bool]]:
        left, last = state
        left = burst if last is None else min(burst, left + (t - last) / 1e6 * per_minute / 60)
        return (left - (left >= 1), t), (left >= 1,)

    return folded(us, keys, [at, tie], ["us__"], [T.StructField("allowed", T.BooleanType())], lambda: (burst, None), step).drop("us__")


def micro_batches(df: DataFrame, keys: list[str], at: str, tie: str, most: int = 10, seconds: float = 5.0) -> DataFrame:
    """df with batch: in order, a batch ends with its `most`-th message or when the next comes so long after its first."""
    us = df.withColumn("us__", F.unix_micros(F.col(at).cast("timestamp")))

    def step(state: tuple[int, int, int], t: int) -> tuple[tuple[int, int, int], tuple[int]]:
        k, n, first = state
        if n >= most or n and t - first >= seconds * 1e6:
            k, n = k + 1, 0
        return (k, n + 1, first if n else t), (k,)

    return folded(us, keys, [at, tie], ["us__"], [T.StructField("batch", T.LongType())], lambda: (0, 0, 0), step).drop("us__")


def backfill(df: DataFrame, keys: list[str], at: str, tie: str, now: Column, hours: int, most: int) -> DataFrame:
    """A conversation's newest messages, `most` of them and none older than so many hours before now."""
    recent = df.filter(F.col(at) >= now - F.expr(f"interval {hours} hours"))
    return top_k(recent, keys, [F.desc(at), F.desc(tie)], most).drop("rank")


def history_guard(df: DataFrame, keys: list[str], at: str, tie: str, cooldown: float = 300.0) -> DataFrame:
    """df with allowed: a conversation's synchronisations are refused for `cooldown` seconds from the last allowed one."""
    us = df.withColumn("us__", F.unix_micros(F.col(at).cast("timestamp")))

    def step(last: int | None, t: int) -> tuple[int | None, tuple[bool]]:
        ok = last is None or t - last >= cooldown * 1e6
        return (t if ok else last), (ok,)

    return folded(us, keys, [at, tie], ["us__"], [T.StructField("allowed", T.BooleanType())], lambda: None, step).drop("us__")


def shard(key: Column, workers: int) -> Column:
    """The worker of a key: h = 31 h + byte over its UTF-8 bytes in 64 bits, without the sign bit of 32, modulo the workers."""
    codes = F.transform(F.sequence(F.lit(1), (F.length(F.hex(key.cast("binary"))) / 2).cast("int")), lambda i: F.conv(F.substring(F.hex(key.cast("binary")), (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda h, b: (h * 31 + b).bitwiseAND(0x7FFFFFFF))
    return F.when(key == "", 0).otherwise(h % workers).cast("int")


def sharded(df: DataFrame, key: str, at: str, workers: int) -> DataFrame:
    """df dealt to so many tasks by key, each in order of time: what ordered workers with a channel each would see. Nothing is dropped."""
    return df.withColumn("worker", shard(F.col(key).cast("string"), workers)).repartition(workers, "worker").sortWithinPartitions("worker", key, at)


def fan_out(subscribers: dict[str, Column]) -> Callable[[DataFrame, int, str], None]:
    """A sink that gives each subscriber the rows of a batch that meet its filter, in a folder of its own; a repeated batch overwrites itself."""

    def put(batch: DataFrame, n: int, path: str) -> None:
        batch.persist()
        for name, wanted in subscribers.items():
            batch.filter(wanted).withColumn("subscriber", F.lit(name)).write.mode("overwrite").parquet(f"{path}/{name}-{n}")
        batch.unpersist()

    return put


def delivered(send: Callable[[DataFrame], None], dead: str, attempts: int = 3) -> Callable[[DataFrame, int, str], None]:
    """A sink that sends a batch up to `attempts` times, in order, and puts it in the folder of dead letters when all fail."""

    def put(batch: DataFrame, n: int, path: str) -> None:
        for k in range(attempts):
            try:
                send(batch)
                batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
                return
            except Exception as e:
                error = f"{type(e).__name__}: {e}"[:500]
        batch.withColumns({"error": F.lit(error), "attempts": F.lit(attempts)}).write.mode("overwrite").parquet(f"{dead}/batch={n}")

    return put


def window_counts(df: DataFrame, at: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return df.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def drained(df: DataFrame, mode: str, put: Callable[[DataFrame, int, str], None] | None = None, every: str | None = None, seconds: float | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Runs a stream over what is there now and reads what it wrote; a batch that is repeated overwrites itself.

    every: polls at this interval in place of once, for so many seconds. What it wrote is deleted as the process ends.
    """
    spark = df.sparkSession
    base = forget_at_exit(spark, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")

    def sink(batch: DataFrame, n: int) -> None:
        (put or (lambda b, k, path: b.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={k}")))(batch, n, f"{base}/out")

    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink)
    q = w.trigger(processingTime=every).start() if every else w.trigger(availableNow=True).start()
    q.awaitTermination(seconds) if every else q.awaitTermination()
    if every:
        q.stop()
    out = spark.read.schema(schema or df.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return out.select(*(schema or df.schema).names)
