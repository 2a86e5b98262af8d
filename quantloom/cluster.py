"""What a query needs from the cluster it runs on: a shared folder, tables written there, and this package on the workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one is set where that is unset in a local session.

    On a cluster without that setting this is an error, as executors do not see the driver's folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = Path(tempfile.mkdtemp(prefix="quantloom-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and sizes are known to the planner. ``options`` are of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote in this program, once nothing reads them any more; how many there were."""
    count = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        count += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return count


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Arrow functions can import it whatever the driver's path is."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quantloom-")) / "quantloom_workers.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def prepare(spark: SparkSession, rows_per_batch: int = 500) -> None:
    """Before Arrow work on texts: this package on the workers, and batches small enough for very long texts."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows_per_batch:
        spark.conf.set(key, str(rows_per_batch))


def default_parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle of the session's usual width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
