"""An optional stream of requests into the persisted queue.

Each micro-batch is folded and merged into the newest version of the queue; the
merged queue is written as a new version named after the batch, so a batch that
runs again after a failure overwrites its own version and nothing is counted twice.
A row's place (the batch and position of its first request) is stored with it;
versions before the last two are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sigloom.operators.requests import COLUMNS, fold_requests, upsert_requests
from sigloom.plans.session import remove_dir

_PLACE = T.StructType([T.StructField("batch", T.LongType()), T.StructField("seq", T.LongType())])
_QUEUE = T.StructType([*[T.StructField(c, T.StringType()) for c in COLUMNS], T.StructField("place", _PLACE)])


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    done = [s.getPath() for s in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("version="))


def current_queue(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest complete version; empty if there is none."""
    return _version(spark, path, None).select(*COLUMNS)


def _version(spark: SparkSession, path: str, before: int | None) -> DataFrame:
    found = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.schema(_QUEUE).parquet(f"{path}/version={found[-1]}") if found else spark.createDataFrame([], _QUEUE)


def merge_stream(requests: DataFrame, path: str, checkpoint: str, seq: str = "request_seq", library: str = "library_request", priority: str = "priority", routes: str = "requested_routes", at: str = "last_requested_utc") -> StreamingQuery:
    """Starts the stream over what is available and stops after it."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        merged = upsert_requests(_version(spark, path, epoch), "place", fold_requests(batch, seq, library, priority, routes, at))
        place = F.coalesce("place", F.struct(F.lit(epoch).cast("bigint").alias("batch"), F.col("first_seq").alias("seq")))
        merged.select(*COLUMNS, place.alias("place")).write.mode("overwrite").parquet(f"{path}/version={epoch}")
        for v in _versions(spark, path):
            if v < epoch - 1:
                remove_dir(spark, f"{path}/version={v}")

    return requests.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
