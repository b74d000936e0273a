"""Session settings under which every query of this library gives the same results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
}

#: Rows and bytes in a batch for Python. A row may hold a whole document of any
#: length, and executor and worker each keep several copies of a batch, outside
#: the heap.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session that exists already."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    small_batches(spark)
    return spark


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of BATCH_ROWS and BATCH_BYTES at most, unless the session asks for smaller ones."""
    for what, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{what}"
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    A temporary folder stands in only where the setting is absent and Spark runs
    inside one process, as in tests; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lathe-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage ends there.

    Unlike a local checkpoint the files outlive the executors that wrote them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lathe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _STORED[back] = path
    return back


_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for this frame, once nothing reads it any more."""
    path = _STORED.pop(df, None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of the shared file system with these bytes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
