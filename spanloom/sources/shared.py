"""The folder for intermediate tables that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where none is named, a session of one machine (master local, as in tests) gets a temporary folder, since its tasks run in
    the driver's process; on a cluster no folder is safe to guess, so it raises ValueError.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: the plan starts anew there and a lost executor costs one step.

    A written table, unlike a checkpoint, does not carry the constraints and sizes that the plan before it had, which grow
    with every round of an iteration until planning takes longer than the work.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    PLACES[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of stored() that nothing will read again, from whatever file system holds them."""
    for df in tables:
        if path := PLACES.pop(df, None):
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
