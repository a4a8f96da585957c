"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers that do not have it installed.

    The zip is made once per SparkContext and travels through Spark's own file
    server, so driver and executors need no common folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_svgloom_shipped", False):
        return spark
    fd, path = tempfile.mkstemp(prefix="svgloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_PACKAGE_DIR):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("svgloom", os.path.relpath(full, _PACKAGE_DIR)))
    sc.addPyFile(path)
    sc._svgloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """URI of a folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests on
    one machine) a local folder is made and registered.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_svgloom_shared", None)
    if base is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="svgloom-shared-")
        spark.sparkContext._svgloom_shared = base
    return base if "://" in base else "file://" + base if base.startswith("/") else base


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/svgloom-{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in four partitions a core by a hash of ``keys``: rows are few bytes but much Python work, so that their number, not their size, must decide who works."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
