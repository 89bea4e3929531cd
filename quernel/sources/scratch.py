"""Intermediate tables that are used more than once.

They lie in a folder of the application below ``spark.checkpoint.dir``, which is
deleted when the application ends, or with ``release`` when no result that reads
them is needed any more.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_USED: dict[str, SparkSession] = {}  # folders of applications


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only on a local master, as in tests, may that be absent."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _OWN["dir"] = _OWN.get("dir") or tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """The path of a new table or folder of this application; nothing is made there yet."""
    own = f"{shared_folder(spark)}/quernel-{spark.conf.get('spark.app.id', 'local')}"
    _USED[own] = spark
    return f"{own}/{label}-{uuid.uuid4().hex}"


def held(df: DataFrame, label: str = "held") -> DataFrame:
    """``df`` written to the application's folder and read back."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes everything this application has held; results that read it can be read no more."""
    for folder, spark in list(_USED.items()):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        del _USED[folder]


@atexit.register
def _at_end() -> None:
    try:
        release()
    except Exception:  # the session is gone already; its folder is named by the application's id
        pass
