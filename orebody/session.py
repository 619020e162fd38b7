"""Shared folder and lineage cuts, as the session configures them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session.

    Only where a local session names none (tests) a temporary folder is made and removed at exit:
    `local[*]` has no other machine that could miss it. A cluster that names none is an error.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="orebody-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and returns it without its lineage.

    Files there outlive any executor, unlike a local checkpoint.
    """
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Writes `df` as a compact table to the shared folder and reads it back; the session removes it when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orebody-{uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_orebody_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="orebody-")  # read by the driver's own file server only
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/orebody_package.zip", "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(f"{folder}/orebody_package.zip")
    context._orebody_shipped = True
