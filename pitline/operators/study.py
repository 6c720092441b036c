"""Event studies: abnormal returns around anchors, their distribution and a permutation null."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitline.functions.crosssection import quantiles
from pitline.functions.timeline import Slots
from pitline.operators.panel import market_return
from pitline.operators.returns import draw
from pitline.session import materialize

#: Anchors of a name that share one copy of its CARs.
ANCHORS_PER_PART = 2000


def abnormal_returns(
    panel: DataFrame,
    market: DataFrame | None = None,
    estimation: int = 60,
    gap: int = 5,
    pre: int = 0,
    post: int = 5,
) -> DataFrame:
    """CAR for every (entity, bar): ``(entity_id, t, car, alpha, beta)``, full windows only.

    The market model is fitted on ``estimation`` bars ending ``gap`` bars before the bar. All
    positions are computed in one pass over each entity's bars, in order, a batch and one entity at a
    time, so anchors and placebo draws are look-ups. ``market`` is ``(event_time, market_ret)``, by
    default the mean of all entities.
    """
    moved = panel.where((F.col("t") > 0) & F.col("ret").isNotNull())
    market = market_return(moved) if market is None else market
    rows = moved.join(market, "event_time").where(F.col("market_ret").isNotNull())
    rows = rows.select("entity_id", "t", "market_ret", "ret")
    schema = T.StructType(
        [*rows.schema[:2], *(T.StructField(c, T.DoubleType()) for c in ("car", "alpha", "beta"))]
    )
    paths = rows.repartition("entity_id").sortWithinPartitions("entity_id", "t")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # bars of the entity that the next batch may go on with
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not table.num_rows:
                continue
            *whole, last = _runs(table["entity_id"])
            yield from _measured(table, whole, estimation, gap, pre, post)
            rest = table.slice(last[0]).combine_chunks().to_batches()[0]
        if rest is not None:
            yield from _measured(pa.Table.from_batches([rest]), [(0, rest.num_rows)], estimation, gap, pre, post)

    return paths.mapInArrow(measured, schema)


def _runs(names: pa.ChunkedArray) -> list[tuple[int, int]]:
    """Start and end of each run of equal names."""
    ends = pc.run_end_encode(names.combine_chunks()).run_ends.to_pylist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _measured(
    table: pa.Table, runs: Sequence[tuple[int, int]], estimation: int, gap: int, pre: int, post: int
) -> Iterator[pa.RecordBatch]:
    """The abnormal returns of whole entities, whose bars are the ``runs`` of rows."""
    market, own = (table[c].to_numpy() for c in ("market_ret", "ret"))
    found = [window_returns(market[a:b], own[a:b], estimation, gap, pre, post) for a, b in runs]
    if not found:
        return
    at = np.concatenate([a + f[0] for (a, _), f in zip(runs, found, strict=True)])
    values = [np.concatenate([f[i] for f in found]) for i in (1, 2, 3)]
    kept = table.select(["entity_id", "t"]).take(pa.array(at))
    for name, column in zip(("car", "alpha", "beta"), values, strict=True):
        kept = kept.append_column(name, pa.array(column))
    yield from kept.to_batches()


def window_returns(market, own, estimation: int, gap: int, pre: int, post: int):
    """``(position, car, alpha, beta)`` of one entity's bars, in order, that have full windows.

    A window's sums are a difference of two running totals, whatever its length. These are taken of
    deviations from the entity's means, which keeps the digits of long histories.
    """
    at = np.arange(gap + estimation, len(own) - post)
    if not len(at):
        return at, *(np.empty(0) for _ in range(3))
    with np.errstate(all="ignore"):
        cx, cy = market.mean(), own.mean()
        x, y = market - cx, own - cy

        def between(values, start, end):
            total = np.concatenate([[0.0], np.cumsum(values)])
            return total[end] - total[np.maximum(start, 0)]

        fit = at - gap - estimation, at - gap
        window = at - pre, at + post + 1
        mx, my, mxx, mxy = (between(v, *fit) / estimation for v in (x, y, x * x, x * y))
        var = mxx - mx * mx
        beta = np.where(var > 1e-18, (mxy - mx * my) / var, np.nan)
        alpha = my - beta * mx
        car = between(y, *window) - (pre + post + 1) * alpha - beta * between(x, *window)
        kept = ~np.isnan(car)
        return at[kept], car[kept], (alpha + cy - beta * cx)[kept], beta[kept]


def at_anchors(anchors: DataFrame, cars: DataFrame, dates: Slots) -> DataFrame:
    """CAR of each anchor at the last bar at or before it. ``dates`` numbers the panel dates."""
    placed = dates.assign(anchors, "anchor", "_after", after=True)
    placed = placed.withColumn("t", F.col("_after") - 1).drop("_after")
    return placed.join(cars.select("entity_id", "t", "car"), ["entity_id", "t"])


def outcome_distribution(cars: DataFrame, by: str = "event_type") -> DataFrame:
    """Count, mean, spread, t-statistic and quantiles of CARs per event type."""
    stats = cars.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("car").alias("mean_car"),
        F.coalesce(F.stddev_samp("car"), F.lit(0.0)).alias("std_car"),
        F.avg((F.col("car") > 0).cast("double")).alias("share_positive"),
    )
    tails = quantiles(cars, [by], "car", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    t = F.when(
        F.col("std_car") > 0, F.col("mean_car") / (F.col("std_car") / F.sqrt("n"))
    ).otherwise(0.0)
    return stats.join(tails, by).select(
        by, "n", "mean_car", "std_car", t.alias("t_stat"), "share_positive", "q10", "q50", "q90"
    )


def _car_arrays(cars: DataFrame) -> DataFrame:
    """``(entity_id, _first, _cars)``: each entity's CARs by bar from its first one on."""
    ends = cars.groupBy("entity_id").agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    bars = ends.withColumn("t", F.explode(F.sequence("_first", "_last")))
    listed = bars.join(cars.select("entity_id", "t", "car"), ["entity_id", "t"], "left")
    by_bar = F.array_sort(F.collect_list(F.struct("t", "car")))
    return listed.groupBy("entity_id", "_first").agg(
        F.transform(by_bar, lambda s: s["car"]).alias("_cars")
    )


def placebo(
    anchors: DataFrame,
    cars: DataFrame,
    observed: DataFrame,
    n_dates: int,
    n_permutations: int = 200,
    seed: int = 0,
    estimation: int = 60,
    gap: int = 5,
    post: int = 5,
    by: str = "event_type",
) -> DataFrame:
    """Share of random re-anchorings of the same names whose mean CAR is at least the observed.

    Every event is moved to a random interior date per permutation; the draw depends only on the
    event, the permutation and the seed. With no room to draw, or fewer than two events, the
    p-value is 1.
    """
    lo, hi = estimation + gap, n_dates - 1 - post - 1
    if hi <= lo:
        means = None
    else:
        # Few rows become n_permutations times as many: spread them by name. A name's CARs travel
        # once per part of its anchors, not with every anchor.
        tasks = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = anchors.groupBy("entity_id").agg(
            F.ceil(F.count(F.lit(1)) / ANCHORS_PER_PART).cast("int").alias("_parts")
        )
        placed = anchors.select(by, "entity_id", "anchor").join(parts, "entity_id").withColumn(
            "_part", F.pmod(F.xxhash64("anchor"), F.col("_parts")).cast("int")
        )
        paths = _car_arrays(cars).join(parts, "entity_id").withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
        )
        on = ["entity_id", "_part"]
        spread = placed.drop("_parts").repartition(tasks, *on).join(
            paths.drop("_parts").repartition(tasks, *on), on
        )
        name = F.concat_ws("|", "entity_id", F.date_format("anchor", "yyyy-MM-dd HH:mm:ss"))
        at = draw(F.lit(hi - lo + 1), seed, F.col("perm").cast("string"), F.col("_name")) + lo + 1
        # The draws are looked up in the name's array and averaged before anything is shuffled. A draw
        # without a CAR is null, which the mean leaves out; a filter would draw a second time.
        means = (
            spread.select(by, name.alias("_name"), "_first", "_cars")
            .withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_permutations))))
            .select(by, "perm", F.get("_cars", (at - F.col("_first")).cast("int")).alias("car"))
            .groupBy(by, "perm")
            .agg(F.avg("car").alias("_mean"))
            .where(F.col("_mean").isNotNull())
        )
    seen = observed.select(by, F.col("n").alias("n_events"), F.col("mean_car").alias("_obs"))
    if means is None:
        null = observed.select(by).limit(0).withColumns(
            {"_n": F.lit(0), "_avg": F.lit(0.0), "_sd": F.lit(0.0), "_ge": F.lit(0)}
        )
    else:
        null = means.join(seen, by).groupBy(by).agg(
            F.count(F.lit(1)).alias("_n"),
            F.avg("_mean").alias("_avg"),
            F.coalesce(F.stddev_samp("_mean"), F.lit(0.0)).alias("_sd"),
            F.sum((F.col("_mean") >= F.col("_obs")).cast("int")).alias("_ge"),
        )
    usable = (F.col("n_events") >= 2) & (F.col("_n") > 0)
    return seen.join(null, by, "left").select(
        by,
        "n_events",
        F.when(usable, F.col("_n")).otherwise(0).cast("long").alias("n_permutations"),
        F.col("_obs").alias("observed_mean_car"),
        F.when(usable, F.col("_avg")).otherwise(0.0).alias("placebo_mean"),
        F.when(usable, F.col("_sd")).otherwise(0.0).alias("placebo_std"),
        F.when(usable, (F.col("_ge") + 1) / (F.col("_n") + 1)).otherwise(1.0).alias("p_value"),
    )


def gate(placebos: DataFrame, alpha: float = 0.05, by: str = "event_type") -> DataFrame:
    """Event types that beat the permutation null with a positive drift."""
    return placebos.where(
        (F.col("n_events") > 1) & (F.col("observed_mean_car") > 0) & (F.col("p_value") <= alpha)
    ).select(by, F.col("observed_mean_car").alias("mean_car"), "p_value")


def run_study(
    anchors: DataFrame, panel: DataFrame, dates: Slots, n_permutations: int = 0, seed: int = 0,
    post: int = 5,
) -> tuple[DataFrame, DataFrame | None]:
    """(outcome distribution, placebo or None) per event type, from anchors and a panel."""
    cars = materialize(abnormal_returns(panel, post=post))
    return measure(materialize(anchors), cars, dates, n_permutations, seed, post)


def measure(
    anchors: DataFrame, cars: DataFrame, dates: Slots, n_permutations: int = 0, seed: int = 0,
    post: int = 5,
) -> tuple[DataFrame, DataFrame | None]:
    """``run_study`` on a CAR table that exists already."""
    observed = outcome_distribution(materialize(at_anchors(anchors, cars, dates)))
    if not n_permutations:
        return observed, None
    observed = materialize(observed)
    return observed, placebo(anchors, cars, observed, dates.n, n_permutations, seed, post=post)
