"""Getting the library to the executors, and cutting lineage where all of them can read it."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Shared folders of local sessions that name none, and the folders of stored frames.
_OWN: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as tmp:
        copy = Path(tmp, "source")
        shutil.copytree(root, copy / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), root.name), "zip", copy)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset on one machine, as in tests, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-')}")


def stored(df: DataFrame, *by: str, **options: str) -> DataFrame:
    """Cuts the lineage: the rows as Parquet files in the shared folder, by the columns `by` if any, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """Stored rows that joins shuffle and never broadcast: Spark takes a frame for as small as its compressed files, where
    coordinates repeat tens of times smaller than the rows that the driver would have to hold."""
    kept = stored(df)
    out = kept.hint("merge")
    _PATHS[out] = _PATHS.pop(kept)
    return out


def released(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that nothing reads any more."""
    for df in frames:
        path = _PATHS.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
