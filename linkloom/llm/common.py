"""Shared plumbing of the corpus operators: tables, shared-folder cuts, Arrow mapping, bounded groups, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one slice of an Arrow batch may hold before it is cut.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; one of this machine only in local mode where none is named, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        d = tempfile.mkdtemp(prefix="linkloom-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


#: What this process has written in shared folders and not deleted yet, with the session that can delete it.
_written: dict[str, SparkSession] = {}
#: The names that buckets among them have in the catalogue.
_tables: dict[str, str] = {}


@atexit.register
def drop_all_cuts() -> None:
    """Deletes all that cut() wrote in this process; runs when the process ends, as its results end with it."""
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone
            break


def _delete(spark: SparkSession, path: str) -> None:
    _written.pop(path, None)
    if name := _tables.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: ends the lineage, survives lost executors, has known size."""
    path = _new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def bucketed_cut(df: DataFrame, keys: list[str]) -> DataFrame:
    """cut() as a table in buckets of the keys, one for each shuffle partition: joins by the keys don't move its rows again.

    The table is external, in the shared folder; its name goes when its files do.
    """
    spark = df.sparkSession
    path, n = _new_path(spark), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    name = path.rpartition("/")[2].replace("-", "_")
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    _tables[path] = name
    out = spark.table(name)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    if path := getattr(df, "_cut_path", None):
        _delete(df.sparkSession, path)


def unused(df: DataFrame, name: str) -> str:
    """The name, longer if df has a column of it in any case."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes; a single longer row is a piece of its own."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


#: Rows of whole texts that go to a Python worker in one Arrow batch: bounds what the worker and the JVM's buffers hold.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to BATCH_ROWS from now on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def add_columns(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[pa.Array]]], fields: list[T.StructField], most: int = SLICE_BYTES) -> DataFrame:
    """df with the new fields after its own columns, from whole texts, Arrow batch by Arrow batch.

    make() is called once a task and gives the function from a list of texts (null: empty) to the new arrays.
    A slice of a batch has about `most` bytes of text, which bounds what fn holds at a time.
    A column of the input whose name a new field has (in any case) is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f.name for f in df.schema if f.name.lower() not in new]
    schema = T.StructType([df.schema[n] for n in kept] + fields)
    extra = text.lower() in new
    src = df.select(*[df[f"`{n}`"] for n in kept], df[f"`{text}`"].alias(unused(df, "text_"))) if extra else df.select(*[df[f"`{n}`"] for n in kept])
    at = len(kept) if extra else next(i for i, n in enumerate(kept) if n.lower() == text.lower())
    names = kept + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            sizes = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
            for part in slices(batch, sizes, most):
                texts = [t or "" for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + fn(texts), names=names)

    return small_batches(src).mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of at least so many rows that hold whole groups only, from batches that are sorted by the integer keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(t.num_rows, bool)
        for k in keys:
            col = t.column(k).to_numpy()
            same &= col == col[-1]
        first = t.num_rows if not same[-1] else int(np.nonzero(~same)[0][-1]) + 1 if not same.all() else 0
        if first:
            yield t.slice(0, first)
        rest = t.slice(first)
        held, n = rest.to_batches(), rest.num_rows
        rows = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group begins in a table that is sorted by the keys."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        col = t.column(k).to_numpy()
        new[1:] |= col[1:] != col[:-1]
    return np.nonzero(new)[0]


def in_blocks(df: DataFrame, key: list[str], member: Column, most: int) -> DataFrame:
    """Deals each group of a key out in pairs of blocks, so that no task holds more than about 2 * most rows of it.

    Adds blk_a, blk_b and own, the member's block. Two members meet where their blocks are blk_a and blk_b. A group of
    up to `most` rows stays whole; the counts that tell this are partial sums, joined by key.
    """
    sizes = df.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    big = df.join(sizes.select(*key, F.ceil(F.col("n") / most).cast("int").alias("s")), key, "left")
    own = F.when(F.col("s").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(member), F.col("s")).cast("int"))
    return (
        big.withColumn("own", own)
        .withColumn("other", F.explode(F.when(F.col("s").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("s") - 1))))
        .withColumn("blk_a", F.least("own", "other"))
        .withColumn("blk_b", F.greatest("own", "other"))
        .drop("s", "other")
    )


def looked_up(df: DataFrame, table: DataFrame, key: str, member: str, salts: int = 16) -> DataFrame:
    """df joined with a table of one row a key; a key's rows go to `salts` tasks by hash of member, as one may hold a third of them."""
    dealt = df.withColumn("dealt__", F.pmod(F.xxhash64(member), F.lit(salts)).cast("int"))
    copies = table.withColumn("dealt__", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [key, "dealt__"]).drop("dealt__")


def roots_of(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """parent after the links a-b are joined: parent[i] is the smallest index of i's component."""
    parent = np.arange(n) if parent is None else parent
    while len(a):
        ra, rb = parent[a], parent[b]
        keep = ra != rb
        if not keep.any():
            break
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected links (u, v): root is the smallest node that links reach.

    Large-star and small-star steps on the links in turn until they no longer change. Minimums are partial
    aggregates joined back by key, so that a node with very many links is split over tasks. Each round is written
    to the shared folder. Links of a node to itself don't count.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        stamp = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if stamp == state or stamp["n"] == 0:
            break
        state = stamp
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = cut(small)
        drop_cut(now)
        now = after
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
