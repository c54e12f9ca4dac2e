"""Sessions and the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "linkloom", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=DEFAULTS | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only in local mode where none is set, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (d or tempfile.mkdtemp(prefix="linkloom-")).rstrip("/")


def forget_at_exit(spark: SparkSession, path: str) -> str:
    """The path, which is deleted when this process ends, as its results end with it."""

    def delete() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone
            return

    atexit.register(delete)
    return path
