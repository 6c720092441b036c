"""Cross-sectional statistics and ranks that do not depend on one task holding a whole group.

A window over ``as_of`` would send every entity of a date to one task. Here statistics are
grouped aggregates (combined on the map side) joined back, and ranks are counted over distinct
values in monotone buckets, so ties of any size collapse to one row before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.session import materialize


def known(value) -> Column:
    """The value as a double, with NaN as null: statistics and ranks leave both out."""
    c = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(c), c)


def zscore(df: DataFrame, by: Sequence[str], cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Standardise columns within each group (population deviation).

    A flat column maps to 0, null stays null and NaN becomes null.
    """
    df = df.withColumns({c: known(c) for c in cols})
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols],
    )
    joined = df.join(stats, list(by))
    for c in cols:
        sd = F.col(f"_s_{c}")
        z = F.when(sd.isNull() | (sd == 0), F.col(c) * 0.0).otherwise(
            (F.col(c) - F.col(f"_m_{c}")) / sd
        )
        joined = joined.withColumn(c + suffix, z)
    return joined.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def value_bucket(x) -> Column:
    """Monotone integer bucket of a double: 32 buckets per power of two, signed.

    The infinities have the outermost buckets, NaN has none.
    """
    c = known(x)
    size = F.floor(F.log2(F.abs(c)) * 32) + 40_000
    endless = F.abs(c) == float("inf")
    return (
        F.when(c == 0, F.lit(0))
        .when(endless, F.signum(c) * 100_000)
        .when(c.isNotNull() & ~endless, F.signum(c) * F.when(~endless & (c != 0), size))
        .cast("int")
    )


def _counted(df: DataFrame, by: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(distinct values with their count ``_n`` and the rows below ``_below``, totals per group).

    Values are counted on the map side, then accumulated inside monotone buckets; bucket totals
    are accumulated apart. No task sees a whole group.
    """
    counts = (
        df.where(known(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", value_bucket(value))
    )
    earlier = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    buckets = (
        counts.groupBy(*by, "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_start", F.coalesce(F.sum("_bn").over(earlier), F.lit(0)))
    )
    inside = W.partitionBy(*by, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.join(buckets.drop("_bn"), [*by, "_b"]).withColumn(
        "_below", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    totals = buckets.groupBy(*by).agg(F.sum("_bn").alias("_total"))
    return placed.select(*by, value, "_n", "_below"), totals


def average_rank(
    df: DataFrame, by: Sequence[str], value: str, out: str = "rank", pct: bool = False
) -> DataFrame:
    """1-based average rank of ``value`` within each group; null and NaN have a null rank."""
    by = list(by)
    placed, totals = _counted(df, by, value)
    ranked = placed.withColumn(out, F.col("_below") + (F.col("_n") + 1) / 2.0)
    if pct:
        ranked = ranked.join(totals, by).withColumn(out, F.col(out) / F.col("_total"))
    return df.join(ranked.select(*by, value, out), [*by, value], "left")


def quantiles(df: DataFrame, by: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """Exact quantiles per group, linear between neighbours: one column per name.

    The two neighbours of each quantile are looked up in the cumulative counts of distinct
    values, so a group of any size is never collected.
    """
    by = list(by)
    placed, totals = _counted(df, by, value)
    rows = placed.join(totals, by)
    aggs = []
    for name, q in named.items():
        at = F.lit(float(q)) * (F.col("_total") - 1)
        low = F.floor(at)
        for part, i in (("lo", low), ("hi", F.least(low + 1, F.col("_total") - 1))):
            hit = (F.col("_below") <= i) & (i < F.col("_below") + F.col("_n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{part}_{name}"))
        aggs.append(F.max(at - low).alias(f"_f_{name}"))
    found = rows.groupBy(*by).agg(*aggs)
    mixed = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
        for n in named
    ]
    return found.select(*by, *mixed)


def ordered_rank(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tie: str,
    out: str = "rank",
    descending: bool = True,
) -> DataFrame:
    """Strict 1..n rank by ``value`` (ties by ascending ``tie``) plus the group size ``<out>_of``.

    The rows are range-partitioned by group, value and tie, numbered inside each range and shifted
    by the rows of the ranges before. Spark samples the bounds of the ranges, so neither a large
    group nor a large tie lands in one task, whatever the names look like. The ranges are written
    once, because numbers and shifts must see the same bounds. Rows with a null or NaN ``value`` are
    dropped.
    """
    by = list(by)
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(tie).asc()]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialize(
        df.where(known(value).isNotNull())
        .repartitionByRange(n, *by, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    group = W.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        ranges.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_shift": F.sum("_n").over(before), f"{out}_of": F.sum("_n").over(group)})
        .drop("_n")
    )
    inside = W.partitionBy(*by, "_range").orderBy(*order)
    number = F.row_number().over(inside) + F.coalesce(F.col("_shift"), F.lit(0))
    return (
        ranges.join(shifts, [*by, "_range"]).withColumn(out, number.cast("long"))
        .drop("_range", "_shift")
    )


def top_k(df: DataFrame, by: Sequence[str], k: int, *order: Column, out: str = "rank") -> DataFrame:
    """First ``k`` rows of each group. Spark prunes to ``k`` per group before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def top_fraction(
    df: DataFrame, by: Sequence[str], value: str, tie: str, fraction: float, cap: int | None = None
) -> DataFrame:
    """Best ``max(1, floor(n * fraction))`` rows of each group, at most ``cap``.

    With a cap no more rows of a group than that are ever ranked: Spark prunes them before the shuffle.
    """
    k = F.greatest(F.lit(1), F.floor(F.col("rank_of") * F.lit(fraction)))
    if cap is None:
        return ordered_rank(df, by, value, tie).where(F.col("rank") <= k)
    rows = df.where(known(value).isNotNull())
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rank_of"))
    best = top_k(rows, by, max(1, cap), F.col(value).desc(), F.col(tie).asc())
    k = F.greatest(F.lit(1), F.least(F.lit(cap), F.floor(F.col("rank_of") * F.lit(fraction))))
    best = best.withColumn("rank", F.col("rank").cast("long"))
    return best.join(sizes, list(by)).where(F.col("rank") <= k)


def compounded(ret, window=None) -> Column:
    """Product of ``1 + ret`` (null counts as 0), as an aggregate or over a window.

    Signs and zeros are carried apart so a return at or below -1 stays exact.
    """
    r = F.col(ret) if isinstance(ret, str) else ret
    g = 1.0 + F.coalesce(r, F.lit(0.0))
    parts = [
        F.sum(F.when(g != 0, F.log(F.abs(g))).otherwise(0.0)),
        F.sum(F.when(g < 0, 1).otherwise(0)),
        F.sum(F.when(g == 0, 1).otherwise(0)),
    ]
    if window is not None:
        parts = [p.over(window) for p in parts]
    logs, negatives, zeros = parts
    return F.when(zeros > 0, F.lit(0.0)).otherwise(
        F.exp(logs) * F.when(negatives % 2 == 1, -1.0).otherwise(1.0)
    )


def running_total(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], sums: dict[str, Column]
) -> DataFrame:
    """Running sums along ``order`` per key, computed chunk by chunk.

    ``chunk`` is a column that never decreases along ``order``. Totals of earlier chunks are
    added to the running sum inside a chunk, so one long series is spread over many tasks.
    """
    keys = list(keys)
    per = df.groupBy(*keys, chunk).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    earlier = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(
        *keys,
        chunk,
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = df.join(offsets, [*keys, chunk])
    for n, v in sums.items():
        joined = joined.withColumn(n, F.col(f"_o_{n}") + F.sum(v).over(inside))
    return joined.drop(*[f"_o_{n}" for n in sums])
