"""Session helpers: tables of a data directory and the shared working folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import warnings
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Bytes that a plan reads by the optimizer's estimates of its sources; sources of unknown size count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where the session names none, and only on a local master, a temporary
    folder is set; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc.getCheckpointDir():
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sigloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """A small table that a plan uses more than once, written to the shared folder so that it is computed once."""
    path = fresh_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_SHIPPED: set[str] = set()


def package_bytes() -> bytes:
    """This package as a zip archive."""
    root = Path(__file__).resolve().parent.parent
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, once per application.

    The archive goes through the shared folder. On a cluster without one the
    package has to be installed on the executors; a warning says so.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    try:
        path = f"{fresh_dir(spark, 'code')}/sigloom.zip"
    except RuntimeError as error:
        warnings.warn(f"{error}, or install sigloom on the executors: the package is not sent to them", stacklevel=2)
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(package_bytes()))
    out.close()
    spark.sparkContext.addPyFile(path)
