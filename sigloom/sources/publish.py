"""Publishing of final tables as single files: written beside the target, then renamed over it.

Spark writes the lines, in one task that sorts and spills on disk; no row passes
the driver. The folder of the target has to be one that the executors share.
Tables that need not be one file are written by Spark's own writers instead.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.plans.session import remove_dir


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on a local or mounted disk; None for other file systems."""
    at, fs = _file_system(spark, path)
    return fs.makeQualified(at).toUri().getPath() if fs.getScheme() == "file" else None


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    """Renames a file over the target in one step."""
    here = local_path(spark, path)
    if here is not None:
        there = local_path(spark, staged)
        with open(there, "rb") as f:
            os.fsync(f.fileno())
        os.chmod(there, 0o644)
        os.replace(there, here)
        return
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    at = jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(jvm.org.apache.hadoop.fs.Path(staged), at, how)


def _publish(lines: DataFrame, path: str, line_end: str = "\n") -> str:
    """``lines`` (value, in the order of the one partition they have) as one file."""
    spark = lines.sparkSession
    at, fs = _file_system(spark, path)
    fs.mkdirs(fs.makeQualified(at).getParent())
    staged = fs.makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fs.makeQualified(at).getParent(), f".{at.getName()}.{uuid.uuid4().hex}.tmp"))
    try:
        lines.write.option("lineSep", line_end).text(staged.toString())
        parts = [s.getPath().toString() for s in fs.listStatus(staged) if s.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise RuntimeError(f"{len(parts)} parts of one file")
        _replace(spark, parts[0], path)
    finally:
        remove_dir(spark, staged.toString())
    return path


def _in_order(df: DataFrame, line: Column, order: Sequence[str], head: str | None = None) -> DataFrame:
    """One partition of lines, ``head`` first, the others by the ``order`` columns."""
    key = F.struct(*[F.col(f"`{o}`") for o in order]) if order else F.lit(0)
    rows = df.select(F.lit(1).alias("k"), key.alias("o"), line.alias("value"))
    if head is not None:
        kind = rows.schema["o"].dataType.simpleString()
        rows = rows.unionByName(df.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(None).cast(kind).alias("o"), F.lit(head).alias("value")))
    one = rows.repartition(1)
    return (one.sortWithinPartitions("k", "o") if order or head is not None else one).select("value")


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\r\n') else text


def csv_line(columns: Sequence[str]) -> Column:
    """Fields joined by commas, quotes only where needed and doubled inside, nulls empty."""
    out = []
    for c in columns:
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        out.append(F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text))
    return F.concat_ws(",", *out)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), columns: Sequence[str] | None = None, allow_empty: bool = False) -> str:
    """Header and rows with ``\\r\\n``, sorted by ``order``, of all or the named ``columns``. No rows are an error unless allowed."""
    names = list(columns or df.columns)
    if not allow_empty and df.isEmpty():
        raise ValueError("refusing to write an empty table")
    return _publish(_in_order(df, csv_line(names), order, ",".join(map(_quoted, names))), path, "\r\n")


def write_tsv(df: DataFrame, path: str, order: Sequence[str] = ()) -> str:
    """Tab-separated rows without header."""
    return _publish(_in_order(df, F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]), order), path)


def write_json_lines(df: DataFrame, path: str, order: Sequence[str] = ()) -> str:
    """One object per row with sorted keys; nulls are written."""
    return _publish(_in_order(df, F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), order), path)


def write_lines(df: DataFrame, path: str, order: Sequence[str] = (), value: str = "value") -> str:
    """The texts of one column as lines."""
    return _publish(_in_order(df, F.col(f"`{value}`"), order), path)


def write_document(df: DataFrame, path: str) -> str:
    """The only row as one indented object with sorted keys and a final newline."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document has exactly one row")
    text = json.dumps(rows[0].asDict(recursive=True), indent=2, sort_keys=True)
    one = df.sparkSession.createDataFrame([(text,)], T.StructType([T.StructField("value", T.StringType())]))
    return _publish(one.coalesce(1), path)


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file, read in blocks where it lies on a local or mounted disk, else whole (under 2 GB)."""
    here = local_path(spark, path)
    if here is not None:
        with open(here, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).first()["d"]
