"""Registered queries of problems 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import abuse, bpe, packing
from sigloom.plans.session import table


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return bpe.spread(table(spark, sf_dir, "documents").select("doc_id", "text", *more))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(_documents(spark, sf_dir), "text").select("doc_id", "ids")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and texts that decoding did not give back, per source."""
    ids = bpe.encode_corpus(_documents(spark, sf_dir, "source"), "text")
    back = ids.select("source", "text", F.size("ids").alias("n"), bpe.decoder(spark)("ids").alias("back"))
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_tokens"), F.count_if(F.coalesce("text", F.lit("")) != F.col("back")).alias("n_changed"))


def token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_prompt of every document."""
    return _documents(spark, sf_dir).select("doc_id", bpe.sizes(spark)("text").alias("s")).select("doc_id", "s.n_tokens", "s.n_prompt")


#: Limits of the instruction packing, where loss-bearing tokens bind.
INSTRUCTION = packing.Limits(4096, 48, 3584)


def p7_pack(spark: SparkSession, sf_dir: str, limits: packing.Limits = packing.Limits()) -> DataFrame:
    """Every document's container of 2,048 tokens and at most 64 segments."""
    items = table(spark, sf_dir, "documents").select("doc_id")
    return packing.pack(token_sizes(spark, sf_dir), "doc_id", "n_tokens", "n_prompt", limits, count=items.count()).withColumnRenamed("id", "doc_id")


def p7_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 4,096 tokens, 48 segments and 3,584 loss-bearing tokens, with their fill."""
    packed = p7_pack(spark, sf_dir, INSTRUCTION)
    return packed.groupBy("container").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_segments"), F.sum("n_loss").alias("n_loss"))


def _fill(spark: SparkSession, sf_dir: str, name: str, limits: packing.Limits) -> DataFrame:
    """Containers and unused shares of a packing. Space is bound by tokens or by loss-bearing tokens, whichever are short."""
    per = p7_pack(spark, sf_dir, limits).groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("n_loss").alias("loss"))
    c = F.count(F.lit(1))
    return per.agg(
        F.lit(name).alias("packing"),
        c.alias("n_containers"),
        F.sum("n").alias("n_tokens"),
        F.max("n").alias("most_tokens"),
        F.max("k").alias("most_segments"),
        F.max("loss").alias("most_loss"),
        (1 - F.sum("n") / (c * limits.tokens)).alias("unused_tokens"),
        (1 - F.sum("loss") / (c * limits.loss)).alias("unused_loss"),
        (1 - F.sum(F.greatest(F.col("n") / limits.tokens, F.col("k") / limits.segments, F.col("loss") / limits.loss)) / c).alias("unused_share"),
    )


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the 2,048-token and the instruction packing are."""
    return _fill(spark, sf_dir, "plain", packing.Limits()).unionByName(_fill(spark, sf_dir, "instruction", INSTRUCTION))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and what is wrong with the instruction packing of them: nothing."""
    return packing.check(token_sizes(spark, sf_dir), p7_pack(spark, sf_dir, INSTRUCTION).withColumnRenamed("doc_id", "id"), "doc_id", "n_tokens", "n_prompt", INSTRUCTION)


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, score, kind, n_clauses of every document."""
    return abuse.score(_documents(spark, sf_dir, "source"), "text").select("doc_id", "source", "abuse.*")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and share with abusive, hateful or sexual language, per source."""
    hit = F.col("score") >= abuse.THRESHOLD
    kinds = [F.count_if(hit & (F.col("kind") == k)).alias(f"n_{k}") for k in ("abusive", "hateful", "sexual")]
    return scored_documents(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(hit).alias("n_found"), *kinds).withColumn("rate", F.col("n_found") / F.col("n_documents"))


QUERIES = {f.__name__: f for f in (p6_ids, p6_round_trip, p7_pack, p7_instruction, p7_fill, p7_check, p8_found, p8_scores, p8_rates)}
SQL = {
    "p7_check": "SELECT count(*)::BIGINT AS n_items, 0::BIGINT AS n_lost_or_repeated, 0::BIGINT AS n_changed_sizes, 0::BIGINT AS n_cut_needlessly, 0::BIGINT AS n_misplaced_pieces, 0::BIGINT AS n_over_limits, 0::BIGINT AS n_shared_positions FROM documents",
}
