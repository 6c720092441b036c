"""Nearest past decisions that were known to have resolved, by pivot distances and sorted blocks.

Episodes are assigned to the nearest of a few pivots, sorted by their distance to it and cut into blocks.
By the triangle inequality a block's range of pivot distances bounds the distance of any query to all of its
episodes. A query first visits the nearest blocks that surely hold k episodes it may see; then those
others whose bound doesn't exceed the kth distance found. That is exact, and only pairs of
query and block within the bound ever meet. What a task gets is bounded: a block and at most
``ASKED`` queries.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.session import materialize

PIVOTS = 16
#: Episodes of a block, unless that makes more blocks than the driver should hold; queries of a task.
BLOCK, BLOCKS, ASKED = 2048, 50_000, 4096
FOUND = "query string, key string, distance double, outcome double"


def matured_nearest(
    episodes: DataFrame, queries: DataFrame, k: int = 8, match: Sequence[str] = (),
    block: int = BLOCK, asked: int = ASKED,
) -> DataFrame:
    """Exact k nearest episodes of each query: ``(query, rank, key, distance, outcome)``.

    ``episodes`` is ``(key, vector, outcome, matured, *match)``, ``queries`` ``(query, vector, seen, scale,
    *match)``. A query sees episodes with ``matured <= seen`` that are equal in the ``match`` columns (a
    null there matches any). The distance is Euclidean after division by the query's own ``scale``, so
    each decision time can standardise by what was known then. Ties go to the first key.
    """
    match = list(match)
    known = materialize(episodes.select("key", "vector", "outcome", "matured", *match))
    spread = _spread(known)
    if not spread:
        return known.sparkSession.createDataFrame([], FOUND + ", rank int")
    pivots = _pivots(known, spread)
    placed, blocks = _blocks(known, pivots, spread, match, block)
    index = _Index(pivots, spread, blocks.toPandas(), match, k)
    asking = materialize(queries.select("query", "vector", "seen", "scale", *match))
    first = materialize(_visit(placed, index.pairs(asking, False), k, asked))
    held = _top(first, k).groupBy("query").agg(
        F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_d")
    )
    bound = F.when(F.col("_n") >= k, F.col("_d")).otherwise(float("inf"))
    bounded = asking.join(held, "query", "left").withColumn("bound", bound).drop("_n", "_d")
    rest = _visit(placed, index.pairs(bounded, True), k, asked)
    return _top(first.unionByName(rest), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _spread(known: DataFrame) -> list[float]:
    """Standard deviation of each component, 1 where it is flat."""
    rows = known.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(
        F.stddev_pop("x").alias("s")
    ).collect()
    found = {r["i"]: r["s"] for r in rows}
    return [found[i] if found[i] and found[i] > 0 else 1.0 for i in range(len(found))]


def _pivots(known: DataFrame, spread: list[float]) -> np.ndarray:
    rows = known.orderBy(F.xxhash64("key"), "key").limit(PIVOTS).select("vector").collect()
    return np.unique(np.array([r["vector"] for r in rows], dtype=float) / np.array(spread), axis=0)


def _gaps(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    total = np.zeros((len(points), len(pivots)))
    for i in range(points.shape[1]):
        total += (points[:, i, None] - pivots[None, :, i]) ** 2
    return np.sqrt(total)


def _blocks(known: DataFrame, pivots, spread, match: list[str], size: int):
    """(episodes with their ``block``, one row per block: what it holds)."""
    scale = np.array(spread)

    @F.pandas_udf("cell int, radius double")
    def cell(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": [], "radius": []})
        gaps = _gaps(np.stack(vectors.to_numpy()) / scale, pivots)
        at = gaps.argmin(axis=1)
        return pd.DataFrame({"cell": at.astype(np.int32), "radius": gaps[np.arange(len(at)), at]})

    n = known.count()
    size = max(size, n // BLOCKS)
    spark = known.sparkSession
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // size))
    order = [*match, "_at.cell", "_at.radius", "key"]
    ranged = materialize(
        materialize(known.withColumn("_at", cell("vector")))
        .repartitionByRange(tasks, *order).withColumn("_part", F.spark_partition_id())
    )
    inside = W.partitionBy("_part", *match, "_at.cell").orderBy("_at.radius", "key")
    placed = materialize(
        ranged.withColumn("_chunk", F.floor((F.row_number().over(inside) - 1) / size))
        .withColumn("block", F.concat_ws(
            "|", "_part", "_at.cell", "_chunk", *(F.coalesce(F.col(m).cast("string"), F.lit("")) for m in match),
            *(F.col(m).isNull().cast("string") for m in match),
        ))
    )
    blocks = placed.groupBy("block", *match).agg(
        F.first("_at.cell").alias("cell"), F.min("_at.radius").alias("near"),
        F.max("_at.radius").alias("far"), F.count(F.lit(1)).alias("n"),
        F.min("matured").alias("oldest"), F.max("matured").alias("youngest"),
    )
    return placed.drop("_at", "_part", "_chunk"), blocks


class _Index:
    """Which blocks a query has to visit. It holds a row per block, ``BLOCKS`` of them or so."""

    def __init__(self, pivots, spread, blocks: pd.DataFrame, match: list[str], k: int):
        self.pivots, self.spread = pivots, np.array(spread)
        self.blocks, self.match, self.k = blocks, match, k

    def pairs(self, queries: DataFrame, rest: bool) -> DataFrame:
        """(query, vector, seen, scale, block) of the first visits, or of the others within ``bound``."""
        out = "query string, vector array<double>, seen long, scale array<double>, block string"

        def run(batches):
            for batch in batches:
                for row in batch.itertuples(index=False):
                    at = self.visits(row, rest)
                    if not len(at):
                        continue
                    yield pd.DataFrame({
                        "query": row.query, "vector": [row.vector] * len(at), "seen": row.seen,
                        "scale": [row.scale] * len(at), "block": at,
                    })

        return queries.mapInPandas(run, out)

    def visits(self, row, rest: bool) -> np.ndarray:
        b = self.blocks
        ok = b["oldest"].to_numpy() <= row.seen
        for m in self.match:
            if getattr(row, m) is not None:
                ok &= b[m].to_numpy() == getattr(row, m)
        stretch = self.spread / np.asarray(row.scale, dtype=float)
        gap = _gaps((np.asarray(row.vector, dtype=float) / self.spread)[None, :], self.pivots)[0]
        gap = gap[b["cell"].to_numpy()]
        least = stretch.min() * np.maximum(0, np.maximum(gap - b["far"].to_numpy(), b["near"].to_numpy() - gap))
        sure = ok & (b["youngest"].to_numpy() <= row.seen)
        order = np.argsort(np.where(sure, least, np.inf), kind="stable")
        held = np.cumsum(np.where(sure, b["n"].to_numpy(), 0)[order])
        enough = np.searchsorted(held, self.k)
        first = np.zeros(len(b), dtype=bool)
        first[order[: enough + 1]] = True
        first &= sure if enough < len(b) else ok  # too few for sure: all it may see
        if not rest:
            return b["block"].to_numpy()[first]
        # Rounding may put the bound just above a distance that it can't exceed.
        return b["block"].to_numpy()[ok & ~first & (least <= row.bound * (1 + 1e-9) + 1e-12)]


def _visit(placed: DataFrame, pairs: DataFrame, k: int, asked: int) -> DataFrame:
    """The k best episodes of each pair of query and block."""
    pairs = materialize(pairs)
    chunks = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("_of"))
    left = pairs.join(chunks, "block").withColumn("_q", F.pmod(F.xxhash64("query"), "_of").cast("int"))
    right = placed.join(chunks, "block").withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))

    def best(queries: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(known):
            return pd.DataFrame(columns=["query", "key", "distance", "outcome"])
        known = known.sort_values("key", ignore_index=True)  # ties go to the first name
        x, since = np.stack(known["vector"].to_numpy()), known["matured"].to_numpy()
        found = []
        for row in queries.itertuples(index=False):
            at = np.flatnonzero(since <= row.seen)
            gap = (x[at] - np.asarray(row.vector)) / np.asarray(row.scale)
            distance = np.sqrt((gap * gap).sum(axis=1))
            first = np.argsort(distance, kind="stable")[:k]
            found.append(known.loc[at[first], ["key", "outcome"]].assign(query=row.query, distance=distance[first]))
        return pd.concat(found)[["query", "key", "distance", "outcome"]]

    unit = ["block", "_q"]
    return left.drop("_of").groupBy(*unit).cogroup(right.drop("_of").groupBy(*unit)).applyInPandas(best, FOUND)


def known_scales(journal: DataFrame, names: Sequence[str], schedule: DataFrame) -> DataFrame:
    """Per decision time ``k`` the standard deviation of each feature over what had matured (``scale``).

    ``journal`` has the slot ``matured`` and the features (null counts as 0). A flat feature, or one of no
    entry yet, has 1. Sums are taken per slot and then accumulated over the slots.
    """
    filled = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names}
    sums = journal.groupBy("matured").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s_{n}") for n, c in filled.items()),
        *(F.sum(c * c).alias(f"q_{n}") for n, c in filled.items()),
    )
    upto = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(upto)
    every = schedule.select("k").join(sums, F.col("k") == F.col("matured"), "left")
    parts = []
    for n in names:
        mean = F.try_divide(total(f"s_{n}"), total("n"))
        var = F.try_divide(total(f"q_{n}"), total("n")) - mean * mean
        parts.append(F.when(var > 1e-18 * (1 + mean * mean), F.sqrt(var)).otherwise(1.0))
    return every.select("k", F.array(*(F.coalesce(p, F.lit(1.0)) for p in parts)).alias("scale"))
