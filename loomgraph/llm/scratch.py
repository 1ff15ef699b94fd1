"""Shared-folder tables that cut lineage, and cluster-level sizes."""

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_BYTES_PER_PART = 32 << 20
#: Spark's estimate for what it has no size of is near 2 ** 63.
_UNKNOWN = 1 << 54
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
#: Whether a query's shuffle files go as soon as it ends, and not when the driver's JVM next collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and the master is local, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all machines share.")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches to Python workers of at most _BATCH_BYTES, unless the session has a limit of its own."""
    if spark.conf.get(_BATCH) in ("67108864b", "64m", "67108864", "-1", "-1b"):
        spark.conf.set(_BATCH, _BATCH_BYTES)


class Scratch:
    """Parquet tables under one folder of the shared directory.

    ``table`` writes a DataFrame and gives the reread one, so an executor that is lost later
    costs a reread, not a recomputation. ``drop`` removes what no later step reads; the rest
    goes when the driver ends, since lazy results still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
        #: What was observed while a table was written: its rows, and what the caller asked for.
        self.seen: dict[str, dict] = {}
        atexit.register(self._remove, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy", **watch: Column) -> DataFrame:
        """``df`` written and reread. What was shuffled for it is deleted when it is written: nothing reads it again."""
        seen = Observation()
        rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[x.alias(k) for k, x in watch.items()])
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            rows.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        finally:
            self.spark.conf.set(_CLEAN, before)
        self.seen[name] = dict(seen.get)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def rows(self, name: str) -> int:
        return self.seen[name]["rows"]

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.path(name))

    def keep(self, *names: str) -> None:
        """Drop all tables but these, which a lazy result still reads."""
        context = self.spark.sparkContext
        root = context._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(context._jsc.hadoopConfiguration())
        if files.exists(root):
            self.drop(*[found for x in files.listStatus(root) if (found := x.getPath().getName()) not in names])

    def _remove(self, path: str) -> None:
        try:
            context = self.spark.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the JVM may be gone at exit
            pass


def parts_for(df: DataFrame) -> int:
    """Partitions for an exchange of about the size of ``df``, a table of files: grows with the input. Where Spark does not know the size, its own number of partitions."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= _UNKNOWN else max(least, size // _BYTES_PER_PART)
