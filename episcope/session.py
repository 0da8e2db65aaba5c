"""What the package needs from a Spark session: the shared scratch folder, and the package on workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session on a local master may leave it unset; its one process then gets a folder beside the
    warehouse, and keeps to it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/episcope-scratch"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage, survives executor loss, and gives later plans column pruning and true sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{spark.sparkContext.applicationId}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def release_scratch(spark: SparkSession) -> bool:
    """Remove the tables that this application wrote to the shared folder; True if there were any.

    For the end of an application, when its results are stored elsewhere: frames that read these tables, and
    views kept by ``plans.views``, cannot be used afterwards.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/{spark.sparkContext.applicationId}")
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Functions that run in tasks are found by module name, and executors need not have the folder that
    the driver imported the package from.
    """
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-episcope-"), "episcope_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(spark.sparkContext.applicationId)
