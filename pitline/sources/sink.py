"""Idempotent ingestion: upsert by id, ingest summaries, resumable backfills. Versions: store.py."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.scalars import observation_id


def upsert(
    existing: DataFrame, batch: DataFrame, sequence: str | None = None,
    key: Sequence[str | Column] = ("observation_id",), spread: Sequence[str | Column] = (),
) -> DataFrame:
    """Insert-or-replace by ``observation_id`` (or ``key``): a row of the batch replaces the stored one.

    One grouped pass instead of a join; the rank limit drops surplus copies before the shuffle. With
    ``spread``, part of the key, rows are dealt by it instead, so that a writer need not deal them again.
    ``sequence`` is a column of the batch that says in which order its rows arrived: of several
    copies of one id the last is kept. It is not stored. Copies that tie in it (or all, without it)
    are ordered by a hash of their content, so that the choice can be repeated.
    """
    at = F.col(sequence).cast("long") if sequence else F.lit(0).cast("long")
    columns = existing.columns
    old = existing.withColumns({"_new": F.lit(0), "_at": F.lit(0).cast("long")})
    new = batch.withColumns({"_new": F.lit(1), "_at": at}).select(*columns, "_new", "_at")
    newest = W.partitionBy(*key).orderBy(
        F.col("_new").desc(), F.col("_at").desc(), F.xxhash64(*columns)
    )
    both = old.unionByName(new)
    if spread:
        both = both.repartition(*spread)
    ranked = both.withColumn("_rn", F.row_number().over(newest))
    return ranked.where(F.col("_rn") == 1).drop("_rn", "_new", "_at")


def stamp_ids(batch: DataFrame) -> DataFrame:
    """Give every fact its derived id."""
    return batch.withColumn("observation_id", observation_id())


def ingest_summary(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: received, distinct ids, ids the store did not hold yet."""
    ids = batch.groupBy("observation_id").agg(F.count(F.lit(1)).alias("copies"))
    new = ids.join(
        existing.select("observation_id").withColumn("_old", F.lit(True)).distinct(),
        "observation_id",
        "left",
    )
    return new.agg(
        F.sum("copies").alias("received"),
        F.count(F.lit(1)).alias("unique_ids"),
        F.count(F.when(F.col("_old").isNull(), 1)).alias("added"),
    )


def symbols_to_fetch(universe: DataFrame, covered: DataFrame) -> DataFrame:
    """Universe symbols without data yet, compared without case."""
    have = covered.select(F.upper("symbol").alias("_s")).distinct()
    return universe.join(have, F.upper(universe["symbol"]) == have["_s"], "left_anti")
