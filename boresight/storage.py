"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch between the executors and their Python workers, unless the session or the cluster says otherwise: with Spark's own bound,
#: which is by rows, long texts would fill memory beside the heap on both sides.
BATCH, DEFAULT_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once for each context."""
    context = spark.sparkContext
    if context.getConf().get(BATCH) is None and spark.conf.get(BATCH, None) == DEFAULT_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)
    if getattr(context, "_boresight_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="boresight-code-")) / "boresight.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._boresight_shipped = True


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; what is there goes when the driver ends, if not before."""
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="boresight-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    files, place = hadoop(spark, path)
    files.deleteOnExit(place)
    return path


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own readers see them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def stored(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and survives lost executors. options: of the writer."""
    path = shared_dir(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._boresight_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        files, place = hadoop(table.sparkSession, table._boresight_path)
        files.delete(place, True)
