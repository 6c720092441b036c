"""Connected components of a link table, in alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.session import materialize

#: Keys that may be hot at most; the same at every size of the table.
HUBS = 1000


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node.

    Each round lets every node point its larger neighbours at the smallest node it knows (large
    star), then its smaller ones (small star), until the links are stars around the smallest node of
    each component; that takes a number of rounds that grows with the logarithm of the longest path.
    A node's neighbours are never collected: the smallest is an aggregate that is joined back, and
    the links of a hub stay spread over the tasks that hold them (``join_spread``).
    Each round is written to the shared folder, so lost executors cost one round at most. Links of a
    node with itself and repeated links change nothing; no links give no rows.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        now = tuple(state.first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        edges = materialize(_small_star(_large_star(edges, now[0]), now[0]))


def join_spread(rows: DataFrame, by_key: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with the one row of ``by_key`` of each key; ``n`` is its number of rows.

    Of ``total`` rows fewer than ``HUBS`` keys can hold more than a ``HUBS``-th; these are broadcast,
    so that their rows stay where they are. All other rows are shuffled by key.
    """
    hot = F.col("n") > total / HUBS
    hubs, others = by_key.where(hot).drop("n"), by_key.where(~hot).drop("n")
    rest = rows.join(F.broadcast(hubs.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hubs), key).unionByName(rest.join(others, key))


def _least(edges: DataFrame) -> DataFrame:
    """(u, m, n): the smallest neighbour of u and the number of its links."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).withColumn("m", F.least("u", "m"))
    found = join_spread(both.where("v > u"), least, "u", 2 * links)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    """Links point from the larger node u to the smaller v; there are at most ``links``."""
    edges = materialize(edges)
    least = _least(edges)
    moved = join_spread(edges, least, "u", links).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
