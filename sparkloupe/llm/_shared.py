"""What the operators of this package share: the shared folder, saved tables, Arrow settings, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: texts can be long, and a batch must fit in a Python worker.
ARROW_ROWS = 1000
#: `[^\x20\x09-\x0D]+` are words in the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds. Session settings, as a lazy result is run after the operator returns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone", "UTC"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='sparkloupe-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Workspace:
    """Tables written to the shared folder, so that lineage is cut and a lost executor costs a reread only.

    Spark deletes the shuffle files of a table's job when it is written. `drop` deletes a table that nothing will read
    again; what a lazy result still reads stays.
    """

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, tag: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{tag}"

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        before = self.spark.conf.get(self.CLEANUP, "false")
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._saved_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self.remove(table._saved_at)

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def components(space: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b) as (id, component), component the smallest id reachable.

    Large-star and small-star steps in turn (Kiveris and others, 2014): each is a grouped minimum, which
    is combined before the shuffle, and an equi-join, whose hot keys AQE splits. Nodes without an edge to
    another node aren't returned. Each round is written to the shared folder.
    """

    def least(pairs: DataFrame) -> DataFrame:
        """(u, m): grouped by one more key that u determines, so that the join to come deals this side anew: AQE splits
        the hot keys of joins between plain shuffles only."""
        return pairs.groupBy("u", F.shiftright("u", 62).alias("top")).agg(F.min("v").alias("m")).drop("top")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = space.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    was = state(now)
    while was[0]:
        both = now.union(now.select("v", "u"))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = least(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = space.save(small.distinct(), "edges")
        space.drop(now)
        now, new_state = new, state(new)
        if new_state == was:
            break
        was = new_state
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


