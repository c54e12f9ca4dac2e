"""Mixing sources to target weights by hash-threshold histograms; DataFrame operations only.

Each document has a size in words and a 60-bit hash of its id and text. A source's target is met by whole copies of
the source, and for the rest by the documents whose hash is under the source's threshold. Thresholds are found by
histograms: words by source and hash bucket (partial sums), the last bucket boundary within the budget, and then only
the rows of the boundary buckets again in finer buckets, until each holds a single hash. Nothing is sorted but a
source's buckets, of which there are a fixed number, and one row a source.

Defined cases: null texts have size 0; the null source comes last; sources without words have target 0; repeated rows
share a hash and are taken together; texts are whole; columns beside id, text and source aren't returned by mix, and
mixed returns all of its input's, whatever their names; an empty table gives an empty table. Reruns agree: nothing is
random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import cut, unused

#: Bits of the hash, and of each level of the histograms.
HASH_BITS, LEVEL_BITS = 60, 12
WEIGHTS = (5, 2, 1)


def words(text: Column) -> Column:
    r"""How many [^\x20\x09-\x0D]+ a text has; null: 0."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(flat, " +"), lambda w: w != "")), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 as a number, from the id and the text; null differs from every value."""
    key = F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("null")), F.lit(":"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    All sources share `share` of all words by weight; a target stops at `most` times its source's size and the excess
    is shared by weight among the others until none is above. In order of size by weight, those that stop are a
    prefix; the rest have one common level. One row a source; the running sums go over those rows only.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("nth")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = named.withColumn("budget", share * F.sum("source_size").over(whole))
    ranked = ranked.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(by_level), F.lit(0.0))))
    first = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("nth"), F.col("level")))).over(whole)
    return ranked.withColumn("first", first).select("source", "source_size", F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("first.level") * F.col("w"))).alias("target"))


def thresholds(sized: DataFrame, aims: DataFrame) -> DataFrame:
    """aims with copies long (of the whole source) and below long: documents with a lower hash are taken once more.

    sized: (source, size, hash). Words under the threshold are at most the rest of the target; the next hash would
    pass it.
    """
    state = aims.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = state.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("below", F.lit(0).cast("long"))
    rows = sized
    for level in range(HASH_BITS // LEVEL_BITS):
        width = 1 << (HASH_BITS - (level + 1) * LEVEL_BITS)
        here = rows.alias("d").join(state.select("source", "below").alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        bins = here.groupBy(F.col("d.source").alias("source"), F.floor((F.col("hash") - F.col("below")) / F.lit(width)).cast("long").alias("bucket")).agg(F.sum("size").alias("words"))
        up = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))).alias("b")
        over = up.join(state.select("source", "rest").alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        over = over.filter(F.col("upto") > F.col("rest")).groupBy(F.col("b.source").alias("source")).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("at"))
        state = state.alias("s").join(over.alias("o"), F.col("s.source").eqNullSafe(F.col("o.source")), "left")
        # a source without words has no such bucket; then it doesn't matter where its threshold lies
        rest = F.when(F.col("at").isNull(), F.col("rest")).otherwise(F.col("rest") - F.col("at.before"))
        below = F.col("below") + F.coalesce(F.col("at.bucket"), F.lit(0)) * F.lit(width)
        state = cut(state.select("s.source", "source_size", "target", "copies", rest.alias("rest"), below.alias("below")))
        there = rows.alias("d").join(state.select("source", "below").alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        there = there.filter((F.col("hash") >= F.col("below")) & (F.col("hash") < F.col("below") + F.lit(width))).select("d.source", "size", "hash")
        rows = cut(there)  # the boundary buckets
        if rows.groupBy("source").agg((F.min("hash") < F.max("hash")).alias("several")).filter("several").isEmpty():
            break
    return state.select("source", "source_size", "target", "copies", "below")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, source, hash, size, source_size, target, taken): a row per row of df; taken words count repeats."""
    sized = cut(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), hash_of(F.col(doc_id), F.col(text)).alias("hash")))
    aims = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights))
    plan = thresholds(sized, aims)
    out = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    return out.select("doc_id", "d.source", "hash", "size", "source_size", "target", (F.col("size") * (F.col("copies") + (F.col("hash") < F.col("below")).cast("long"))).alias("taken"))


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """The rows of df as often as the mix takes them (by default up to twice)."""
    named = {n: unused(df, n) for n in ("hash", "from", "copies", "below", "nth")}
    base = df.withColumn(named["hash"], hash_of(F.col(doc_id), F.col(text)))
    sized = cut(base.select(F.col(source).alias("source"), words(F.col(text)).alias("size"), F.col(named["hash"]).alias("hash")))
    aims = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), kw.get("share", 1.5), kw.get("most", 2.0), kw.get("weights", WEIGHTS)))
    plan = thresholds(sized, aims).select(F.col("source").alias(named["from"]), F.col("copies").alias(named["copies"]), F.col("below").alias(named["below"]))
    times = F.col(named["copies"]) + (F.col(named["hash"]) < F.col(named["below"])).cast("long")
    rows = base.join(plan, F.col(source).eqNullSafe(F.col(named["from"]))).withColumn(named["nth"], F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<long>"))))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns])
