"""The queue of requests nobody could answer: one row per normalised name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.text import normalise_request, strip, unpack

#: Columns of the queue in file order (fixed values).
COLUMNS = ["library_request", "priority", "status", "resolution_lane", "requested_routes", "first_requested_utc", "last_requested_utc", "request_count", "candidate_version", "candidate_source_url", "candidate_sha256", "notes"]


def fold_requests(incoming: DataFrame, seq: str, library: str, priority: str, routes: str, at: str) -> DataFrame:
    """Requests in ``seq`` order folded per normalised name.

    Columns: ``request_key``, those of the queue (typed) and ``first_seq``, where
    the name was first asked for. Priority is the
    least readable one; routes are the sorted union of the packed lists; the
    first spelling and time and the last time *in order* stay. Nulls and empty
    names are no requests. Partial aggregation folds a busy name before it is
    shuffled; route sets hold the routes that exist, not one entry per request.
    """
    rows = incoming.select(F.col(seq).alias("seq"), strip(library).alias("library"), normalise_request(library).alias("request_key"), strip(F.col(priority).cast("string")).try_cast("int").alias("priority"), unpack(routes).alias("routes"), F.col(at).alias("at")).where("request_key <> ''")
    single = rows.groupBy("request_key").agg(
        F.min_by(F.struct("library"), F.col("seq")).alias("first_name"),
        F.min("priority").alias("priority"),
        F.min_by(F.struct("at"), F.col("seq")).alias("first_at"),
        F.max_by(F.struct("at"), F.col("seq")).alias("last_at"),
        F.count(F.lit(1)).alias("request_count"),
        F.min("seq").alias("first_seq"),
    )
    sets = rows.select("request_key", F.explode("routes").alias("route")).distinct().groupBy("request_key").agg(F.array_sort(F.collect_set("route")).alias("routes"))
    return single.join(sets, "request_key", "left").select(
        "request_key",
        F.col("first_name.library").alias("library_request"),
        "priority",
        F.lit("pending").alias("status"),
        F.lit("source_discovery").alias("resolution_lane"),
        F.array_join(F.coalesce("routes", F.array().cast("array<string>")), ";").alias("requested_routes"),
        F.col("first_at.at").alias("first_requested_utc"),
        F.col("last_at.at").alias("last_requested_utc"),
        "request_count",
        *[F.lit("").alias(c) for c in COLUMNS[8:]],
        "first_seq",
    )


def upsert_requests(existing: DataFrame, order: str, folded: DataFrame) -> DataFrame:
    """``existing`` queue rows (strings, in ``order``) merged with folded requests.

    Of rows with one normalised name the last is updated and earlier ones stay;
    priority becomes the lesser, routes the union, the count the sum, the last
    time the newer call's; other columns keep what they hold. New names are
    added. Priorities and counts that are no numbers count as absent. Existing
    rows keep their ``order`` in the column ``place``; ``first_seq`` is where a
    new name was first asked for. Sorted by both, nulls last, existing rows
    stay where they were and new ones follow as they came.
    """
    old = existing.withColumn("request_key", normalise_request("library_request"))
    last = old.groupBy("request_key").agg(F.max(order).alias("__last"))
    tagged = old.join(last, "request_key", "left").withColumn("__update", F.col(order) == F.col("__last"))
    new = folded.select("request_key", F.col("first_seq").alias("n_first_seq"), *[F.col(c).cast("string").alias(f"n_{c}") for c in COLUMNS])
    both = tagged.where("__update").join(new, "request_key", "full_outer")
    hit = F.col("n_request_count").isNotNull()
    fresh = F.col("library_request").isNull() & hit
    routes = F.array_join(F.array_sort(F.array_union(unpack("requested_routes"), unpack("n_requested_routes"))), ";")
    changed = {
        "priority": F.least(strip("priority").try_cast("int"), F.col("n_priority").try_cast("int")).cast("string"),
        "requested_routes": routes,
        "last_requested_utc": F.col("n_last_requested_utc"),
        "request_count": (F.coalesce(strip("request_count").try_cast("bigint"), F.lit(0)) + F.col("n_request_count").cast("bigint")).cast("string"),
    }
    merged = both.select("request_key", *[F.when(fresh, F.col(f"n_{c}")).when(hit, changed.get(c, F.col(c))).otherwise(F.col(c)).alias(c) for c in COLUMNS], F.col(f"`{order}`").alias("place"), F.when(fresh, F.col("n_first_seq")).alias("first_seq"))
    kept = tagged.where(~F.coalesce("__update", F.lit(False))).select("request_key", *COLUMNS, F.col(f"`{order}`").alias("place"), F.lit(None).cast("bigint").alias("first_seq"))
    return merged.unionByName(kept)
