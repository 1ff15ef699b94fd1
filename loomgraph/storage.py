"""Tables in the shared folder that cut lineage between supersteps."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and the master is local, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all machines share.")
        found = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def state_path(spark: SparkSession) -> str:
    """A new place for a table of the running process; it is removed when the process ends."""
    root = getattr(spark.sparkContext, "_loomgraph_state", None)
    if root is None:
        root = spark.sparkContext._loomgraph_state = f"{shared_folder(spark)}/loomgraph/state/{uuid.uuid4().hex}"
        atexit.register(remove, spark, root)
    return f"{root}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; at exit the JVM may be gone, then it stays."""
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:
        pass


def store(df: DataFrame, path: str | None = None, compression: str = "snappy", group: int | None = None) -> tuple[DataFrame, int]:
    """``df`` written as Parquet and reread, and its number of rows, observed while writing. ``group``: rows of a row group at most, for rows of megabytes, of which Parquet would hold a hundred before it looks at their size."""
    spark = df.sparkSession
    path = path or state_path(spark)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", compression)
    if group:
        out = out.option("parquet.block.row.count.limit", group)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]
