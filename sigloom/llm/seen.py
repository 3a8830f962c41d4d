"""Has this key been seen before? Exact answers from disk-backed keyed state.

A Structured Streaming query keeps one value per key, the place of the key's
first occurrence, in RocksDB state stores: partitioned by key, checkpointed to
the shared folder, never expired (no watermark). Every row, of the history and
of what arrives, goes through it in the turn it comes; the state emits the
first place of each key that a turn touches, and a row is a first occurrence if
that place is its own, else a repeat. State lives on the executors' disks,
memory is bounded by RocksDB's budget. Keys are compared in full, so the rate
of wrong answers is zero.

The stream's partial aggregate folds rows of one key before they are shuffled,
so a key that holds a third of all rows costs no more than any other; rows are
told their answer by a join that broadcasts the places of such keys. A store
stays usable: a later turn reads its own rows only, not those before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.operators.skew import skewed_join
from sigloom.plans.session import fresh_dir, input_bytes, remove_dir

_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


#: Bytes of history for a partition of the state.
STATE_BYTES = 256 << 20


class SeenStore:
    """Keyed state below ``path``, with keys of the given types compared in full.

    Rows of one turn are in the order of columns of ``order_types``, then of
    their id; turns are in the order of the calls. ``partitions`` of the state
    are fixed with the first turn (by default the session's shuffle partitions).
    ``batch_bytes`` of staged rows make a micro-batch; more are taken in by
    several. The state is read and written in a session of its own, so that
    settings of the caller's session stay as they are.
    """

    def __init__(self, spark: SparkSession, path: str, key_types: Sequence[T.DataType], order_types: Sequence[T.DataType] = (), partitions: int | None = None, batch_bytes: int = 64 << 30):
        self.spark, self.path, self.batch_bytes = spark, path, batch_bytes
        self.keys = [f"k{i}" for i in range(len(key_types))]
        self.key_types, self.order_types = list(key_types), list(order_types)
        place = T.StructType([T.StructField("turn", T.IntegerType()), *[T.StructField(f"o{i}", t) for i, t in enumerate(order_types)], T.StructField("id", T.LongType())])
        self.schema = T.StructType([*[T.StructField(k, t) for k, t in zip(self.keys, key_types)], T.StructField("place", place)])
        self.turn = 0
        self.session = spark.newSession()
        for k, v in (_CONF | {"spark.sql.shuffle.partitions": str(partitions or spark.conf.get("spark.sql.shuffle.partitions")), "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone")}).items():
            self.session.conf.set(k, v)

    def place(self, row_id: Column | None = None, order: Sequence[Column] = ()) -> Column:
        """Where a row of the present turn stands."""
        o = [*order, *[F.lit(None)] * (len(self.order_types) - len(order))]
        return F.struct(F.lit(self.turn).alias("turn"), *[c.cast(t).alias(f"o{i}") for i, (c, t) in enumerate(zip(o, self.order_types))], (F.lit(None) if row_id is None else row_id).cast("bigint").alias("id"))

    def take(self, rows: DataFrame, answers: bool) -> DataFrame | None:
        """Lets rows (keys, place) into the state; with ``answers``, each touched key and its first place.

        Staged rows are removed afterwards, also on an error.
        """
        staged, told = f"{self.path}/input/turn={self.turn}", f"{self.path}/told/turn={self.turn}"
        try:
            rows.write.mode("error").parquet(staged)
            stream = self.session.readStream.schema(self.schema).option("recursiveFileLookup", "true").option("maxBytesPerTrigger", str(self.batch_bytes)).parquet(f"{self.path}/input")
            first = stream.groupBy(*self.keys).agg(F.min("place").alias("place"))

            def keep(batch: DataFrame, epoch: int) -> None:
                if answers:  # a batch that runs again overwrites its own folder
                    batch.write.mode("overwrite").parquet(f"{told}/batch={epoch}")
                else:
                    batch.write.format("noop").mode("overwrite").save()

            q = first.writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).outputMode("update").start()
            try:
                q.awaitTermination()
            finally:
                q.stop()
        finally:
            remove_dir(self.spark, staged)
        self.turn += 1
        if not answers:
            return None
        found = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(told)
        # a key that several micro-batches touch is told by each
        return found.groupBy(*self.keys).agg(F.min("place").alias("place"))

    def load(self, df: DataFrame, keys: Sequence[Column]) -> None:
        """Marks the keys of ``df`` as seen. Rows with a null key part have no key."""
        rows = df.select(*[k.cast(t).alias(n) for k, t, n in zip(keys, self.key_types, self.keys)]).dropna()
        self.take(rows.withColumn("place", self.place()), answers=False)

    def mark(self, df: DataFrame, keys: Sequence[Column], row_id: str, order: Sequence[str], flag: str) -> DataFrame:
        """``df`` with ``flag``: false for the first row ever with its key, true for every later one, null without key or id."""
        names = [c for c in df.columns if c != flag]
        own = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], *[k.cast(t).alias(n) for k, t, n in zip(keys, self.key_types, self.keys)], self.place(F.col(f"`{row_id}`"), [F.col(f"`{o}`") for o in order]).alias("own"))
        keyless = F.col("own.id").isNull()
        for k in self.keys:
            keyless = keyless | F.col(k).isNull()
        rows = own.where(~keyless)
        told = self.take(rows.select(*self.keys, F.col("own").alias("place")), answers=True)
        answered = skewed_join(rows, told, self.keys).withColumn("__seen", F.col("place") != F.col("own"))
        rest = own.where(keyless).withColumn("__seen", F.lit(None).cast("boolean"))
        every = answered.select(*[f"c{i}" for i in range(len(names))], "__seen").unionByName(rest.select(*[f"c{i}" for i in range(len(names))], "__seen"))
        return every.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("__seen").alias(flag))

    def forget(self) -> None:
        """Removes the state; answers already told stay readable."""
        for part in ("input", "checkpoint"):
            remove_dir(self.spark, f"{self.path}/{part}")


def store_for(df: DataFrame, keys: Sequence[Column], order: Sequence[str], path: str | None = None, **options) -> SeenStore:
    """An empty store for rows such as those of ``df``; by default in a new folder below the shared one."""
    spark = df.sparkSession
    types = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(f"`{o}`").alias(f"o{i}") for i, o in enumerate(order)]).schema
    return SeenStore(spark, path or fresh_dir(spark, "seen"), [f.dataType for f in types[: len(keys)]], [f.dataType for f in types[len(keys) :]], **options)


def first_or_repeat(history: DataFrame, history_keys: Sequence[Column], incoming: DataFrame, incoming_keys: Sequence[Column], row_id: str, order: Sequence[str], flag: str = "seen_before", **options) -> DataFrame:
    """``incoming`` with a boolean ``flag``: whether the key is in ``history`` or in an earlier incoming row.

    Earlier means smaller by ``order`` (nulls first), ties by ``row_id``
    (unique). A row with a null in its key has no key, one without ``row_id``
    no place: their flags are null. Empty inputs are fine. A column of the
    flag's name is replaced. The stream runs when this is called; the returned
    table reads the answers it told. Its state is removed, also on an error; to
    keep it, use a :class:`SeenStore`, whose later turns do not read the history
    again. ``options`` are those of the store; the state has by default a
    partition for every ``STATE_BYTES`` of history, and those of the session at least.
    """
    spark = incoming.sparkSession
    fitting = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(history) // STATE_BYTES)
    options = {"partitions": fitting} | options
    store = store_for(incoming, incoming_keys, order, **options)
    try:
        store.load(history, history_keys)
        return store.mark(incoming, incoming_keys, row_id, order, flag)
    finally:
        store.forget()
