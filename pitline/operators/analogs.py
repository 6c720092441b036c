"""Nearest past situations and how they resolved; recommendations built on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.scalars import case_against, recommendation_confidence

#: Queries and episodes that meet in one task.
QUERY_BLOCK, EPISODE_BLOCK = 2048, 32_768


def nearest(
    episodes: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    match: Sequence[str] = (),
    block: int = QUERY_BLOCK,
    episode_block: int = EPISODE_BLOCK,
) -> DataFrame:
    """Exact k nearest episodes of each query: ``(query, rank, key, distance, outcome)``.

    ``queries`` is ``(query, vector, *match)``; only episodes equal in the ``match`` columns
    (regime, event_type) count, a null there matches any. Both sides are cut into blocks of bounded
    size by a hash of their names, and every pair of blocks is one unit of work that keeps its k best
    per query. Nothing passes through the driver, and each episode is read once.
    """
    match = list(match)
    asked = queries.select("query", F.col("vector").alias("target"), *match)
    known = episodes.select("key", "vector", "outcome", *match)
    n_asked, n_known = max(1, -(-asked.count() // block)), max(1, -(-known.count() // episode_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.withColumns({"_q": of("query", n_asked), "_e": every(n_known)})
    right = known.withColumns({"_q": every(n_asked), "_e": of("key", n_known)})
    unit = ["_q", "_e"]
    candidates = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInPandas(
        _best_of_blocks(k, match), "query string, key string, distance double, outcome double"
    )
    w = W.partitionBy("query").orderBy("distance", "key")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_of_blocks(k: int, match: list[str]):
    def best(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(known):
            known = known.sort_values("key", ignore_index=True)  # ties go to the first name
            vectors = np.stack(known["vector"].to_numpy())
            columns = {m: known[m].to_numpy() for m in match}
            for row in asked.itertuples(index=False):
                fits = np.ones(len(known), dtype=bool)
                for m in match:
                    value = getattr(row, m)
                    if value is not None:
                        fits &= columns[m] == value
                at = np.flatnonzero(fits)
                gap = vectors[at] - np.asarray(row.target, dtype=float)
                distance = np.sqrt((gap * gap).sum(axis=1))
                first = np.argsort(distance, kind="stable")[:k]
                found.append(
                    known.loc[at[first], ["key", "outcome"]].assign(
                        query=row.query, distance=distance[first]
                    )
                )
        columns = ["query", "key", "distance", "outcome"]
        return pd.concat(found)[columns] if found else pd.DataFrame(columns=columns)

    return best


def outcomes(neighbours: DataFrame) -> DataFrame:
    """Distribution of the neighbours' outcomes per query."""
    q = F.percentile("outcome", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    stats = neighbours.groupBy("query").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("outcome").alias("mean"),
        q.alias("_q"),
        F.avg((F.col("outcome") > 0).cast("double")).alias("share_positive"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda s: s["key"]
        ).alias("neighbours"),
    )
    return stats.select(
        "query", "n", "mean", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q10"),
        F.col("_q")[2].alias("q90"), "share_positive", "neighbours",
    )


def episode_key() -> Column:
    """The name of a decision: entity and day."""
    return F.concat("entity_id", F.lit("@"), F.date_format("as_of", "yyyy-MM-dd"))


def recommend(
    scores: DataFrame, events: DataFrame, analogs: DataFrame | None = None, top_n: int = 5
) -> DataFrame:
    """Top names per decision time with events, confidence and the case against each.

    ``events`` is ``(as_of, entity_id, event_type)``, ``analogs`` the ``outcomes`` of past decisions per
    ``as_of`` and ``entity_id``.
    """
    w = W.partitionBy("as_of").orderBy(F.col("score").desc(), "entity_id")
    best = scores.where(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(w))
    best = best.where(F.col("rank") <= top_n)
    # Events are counted per type before they are listed, so a name's list is short.
    kinds = events.groupBy("as_of", "entity_id", "event_type").agg(F.count(F.lit(1)).alias("_c"))
    listed = kinds.groupBy("as_of", "entity_id").agg(
        F.array_sort(F.collect_list("event_type")).alias("events"), F.sum("_c").alias("n_events")
    )
    rows = best.join(listed, ["as_of", "entity_id"], "left")
    if analogs is not None:
        rows = rows.join(
            analogs.select("as_of", "entity_id", F.col("n").alias("analog_n"), "share_positive", "q10"),
            ["as_of", "entity_id"],
            "left",
        )
    else:
        rows = rows.withColumns(
            {"analog_n": F.lit(0), "share_positive": F.lit(None).cast("double"),
             "q10": F.lit(None).cast("double")}
        )
    return rows.select(
        "as_of",
        "entity_id",
        "rank",
        F.round("score", 4).alias("quant_score"),
        recommendation_confidence("score", "analog_n", "share_positive").alias("confidence"),
        F.coalesce("events", F.array().cast("array<string>")).alias("events"),
        F.coalesce("analog_n", F.lit(0)).cast("long").alias("analog_n"),
        case_against("score", "analog_n", "share_positive", "q10", "n_events").alias(
            "case_against"
        ),
    )
