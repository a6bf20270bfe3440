"""Shared working folder, table reader and lineage cuts.

The cluster names a folder that every executor sees in ``spark.checkpoint.dir``;
only where that is unset (tests, laptops) does a local one take its place.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, registered as checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc
    if not named:
        named = jsc.sc().conf().get("spark.checkpoint.dir", "") or None
    if not named:
        current = jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not jsc.sc().master().startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that every executor sees")
        named = "file://" + os.path.join(tempfile.gettempdir(), "ledgerloom-work")
    if jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; no two calls return the same."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), "ledgerloom.zip")  # the driver serves it from here
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    whole = os.path.join(folder, f)
                    z.write(whole, os.path.relpath(whole, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def settle(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Cut lineage: write the rows as a table in the shared folder and read them back.

    A written table is compressed and outlives any executor.  ``instead_of`` names
    an earlier settled frame that is no longer read; its table is removed once the
    new one is complete.  Other tables stay for the frames that read them, until the
    folder is cleaned.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "settled")
    df.write.parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    done.__dict__["_settled_at"] = path
    if instead_of is not None and (old := instead_of.__dict__.pop("_settled_at", None)):
        where = spark._jvm.org.apache.hadoop.fs.Path(old)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        # in a loop the shuffle files of earlier rounds go only when the driver collects its garbage
        spark._jvm.System.gc()
    return done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
