"""Helpers that the operators of this subpackage share: scratch tables, text rules, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank and U+0009..U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for bytes.translate; bytes.split() without arguments splits at SPACES exactly.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def free(name: str, df: DataFrame) -> str:
    """name, or what it becomes so that df has no column called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: The folders of local sessions without spark.checkpoint.dir, by application: the setting can't be changed in a running one.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may go without; it gets a temporary one."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="vintra-")
    return _LOCAL[app]


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder. They survive lost executors and cut the lineage."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables of save() that nothing will read any more."""
        for df in frames:
            self._delete(df._scratch)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root): the smallest node that each node reaches; nodes without edges don't occur.

    Alternating large-star and small-star rounds, each a pre-aggregated minimum and a join back, every round written to
    the shared folder. The joins read two written tables, so that adaptive execution can split a hub's rows.
    No input: no rows. Self loops, repeated and reversed pairs are fine.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "large")
        large = scratch.save(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "star")
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        linked = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = scratch.save(linked.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        scratch.drop(now, least, large, low)
        now = after
        # a star forest has one edge for each node that isn't a root, and no root is a node's child
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
