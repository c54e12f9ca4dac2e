"""Tables in and out: Parquet, CSV and JSON readers and writers, catalogue, previews and plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, whole: bool = False) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=whole)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def backup(df: DataFrame, name: str, path: str | None = None) -> None:
    """A copy as a table of the catalogue, in the warehouse or a folder of its own."""
    w = df.write.mode("overwrite")
    (w.option("path", path) if path else w).saveAsTable(name)


def raw_sql(spark: SparkSession, sf_dir: str, text: str, **params: object) -> DataFrame:
    """SQL text over the tables of a folder, which it names in braces; :names are parameters."""
    return spark.sql(text, args=params, **{n: table(spark, sf_dir, n) for n in NAMES if "{" + n + "}" in text})


def write_by_month(df: DataFrame, at: str, path: str) -> None:
    """Append-only log in a folder for each month."""
    df.withColumns({"year": F.year(at), "month": F.month(at)}).write.mode("append").partitionBy("year", "month").parquet(path)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(name, english, synonym) from a JSON object of name to {english, synonyms}."""
    entry = T.StructType([T.StructField("english", T.StringType()), T.StructField("synonyms", T.ArrayType(T.StringType()))])
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), entry)).alias("m"))
    return whole.select(F.explode("m").alias("name", "e")).select("name", "e.english", F.explode_outer("e.synonyms").alias("synonym"))


def columns_of(df: DataFrame, name: str) -> DataFrame:
    rows = [(name, f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, type string, nullable boolean")


def counts_of(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    parts = [table(spark, sf_dir, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(masters, aliases) from a seed file {medications: [{canonical_name, ..., aliases: [...]}]}; aliases name their master."""
    item = "struct<canonical_name:string,canonical_name_ar:string,active_ingredient:string,strength:string,dosage_form:string,manufacturer:string,therapeutic_class:string,atc_code:string,aliases:array<string>>"
    whole = spark.read.json(path, schema=f"version string, description string, medications array<{item}>", multiLine=True)
    m = whole.select(F.explode("medications").alias("m")).select("m.*")
    return m.drop("aliases"), m.select("canonical_name", F.explode("aliases").alias("alias"))


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def storage_of(df: DataFrame, name: str) -> DataFrame:
    """(table_name, files, bytes) of a table read from files; what a database keeps beside that has no counterpart here."""
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).groupBy("p").agg(F.max("s").alias("s"))
    return files.agg(F.lit(name).alias("table_name"), F.count("*").alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("bytes"))


def plan_summary(df: DataFrame) -> dict[str, object]:
    """Counts of scans, exchanges and joins in a plan, and scans without a pushed filter, which read a table whole."""
    text = plan_of(df)
    count = lambda p: len(re.findall(p, text, re.M))
    whole = [m[0] for m in re.finditer(r"^\(\d+\) Scan .*(?:\n(?!\n).*)*", text, re.M) if "PushedFilters: [" not in m[0]]
    return {"scans": count(r"^\(\d+\) Scan "), "exchanges": count(r"^\(\d+\) (?:Broadcast)?Exchange"), "joins": count(r"^\(\d+\) \w*Join"), "nested_loops": count(r"^\(\d+\) (?:BroadcastNestedLoopJoin|CartesianProduct)"), "whole_scans": len(whole)}
