"""Dense price panels: last price per (time, entity), forward fill, returns, forward returns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.timeline import calendar_of
from pitline.operators.bitemporal import order_key



def by_entity():
    """Window along one entity's grid rows: at most one row per panel date."""
    return W.partitionBy("entity_id").orderBy("t")


def last_prices(price_facts: DataFrame, field: str = "close") -> DataFrame:
    """One price per (event_time, entity): the last non-null one in read order."""
    known = price_facts.where(F.col(field).isNotNull())
    return known.groupBy("event_time", "entity_id").agg(
        F.max_by(F.col(field).cast("double"), order_key("observation_id")).alias("close")
    )


def dense_panel(bars: DataFrame) -> DataFrame:
    """Every entity on the global date grid: ``(entity_id, t, event_time, px, ff, ret)``.

    ``px`` is the raw price (null in gaps), ``ff`` the forward-filled one (null before the first
    price), ``ret`` the change of ``ff``: 0 in a gap, the full move on the bar that ends it.
    The grid is built by repeating each bar up to the entity's next bar, so there is no
    dates x entities join. ``bars`` must hold one row per (event_time, entity_id).
    """
    known = bars.where(F.col("close").isNotNull()).select("entity_id", "event_time", "close")
    calendar = calendar_of(known)
    placed = known.join(calendar, "event_time")
    first = F.lag("t").over(by_entity()).isNull()
    spread = placed.select(
        "entity_id",
        "close",
        "n_dates",
        F.col("t").alias("_at"),
        F.when(first, F.lit(0)).otherwise(F.col("t")).alias("_from"),
        (F.coalesce(F.lead("t").over(by_entity()), F.col("n_dates")) - 1).alias("_to"),
    )
    grid = spread.withColumn(
        "t", F.explode(F.sequence(F.col("_from").cast("int"), F.col("_to").cast("int")))
    )
    dense = grid.select(
        "entity_id",
        "t",
        F.when(F.col("t") == F.col("_at"), F.col("close")).alias("px"),
        F.when(F.col("t") >= F.col("_at"), F.col("close")).alias("ff"),
        "n_dates",
    )
    dense = dense.withColumn("ret", F.try_divide(F.col("ff"), F.lag("ff").over(by_entity())) - 1.0)
    stamps = calendar.select(F.col("t").cast("int").alias("t"), "event_time")
    return dense.join(stamps, "t").select(
        "entity_id", "t", "event_time", "px", "ff", "ret", "n_dates"
    )


def price_series(
    bars: DataFrame, calendar: DataFrame, at: Sequence[int] = (),
    vols: dict[str, tuple[int, bool]] | None = None,
) -> DataFrame:
    """``dense_panel`` as one row per entity: ``(entity_id, ff, ret)``, arrays with a value per date.

    ``calendar`` is ``calendar_of`` the bars. The bars are shuffled and sorted once; prices are carried
    forward in Arrow batches, whole entities at a time. ``vols`` names ``rolling_vol`` columns by their
    (window, sample), taken at the panel positions ``at`` only: arrays with a value per position.
    """
    vols = vols or {}
    n = calendar.count()
    stamps = calendar.select("event_time", F.col("t").cast("int").alias("t"))
    known = bars.where(F.col("close").isNotNull()).join(stamps, "event_time")
    placed = known.select("entity_id", "t", F.col("close").cast("double").alias("close"))
    paths = placed.repartition("entity_id").sortWithinPartitions("entity_id", "t")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # bars of the entity that the next batch may go on with
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            if not table.num_rows:
                continue
            ends = pc.run_end_encode(table["entity_id"].combine_chunks()).run_ends.to_pylist()
            if len(ends) > 1:
                yield _series(table.slice(0, ends[-2]), ends[:-1], n, at, vols)
            rest = table.slice(ends[-2] if len(ends) > 1 else 0).combine_chunks().to_batches()[0]
        if rest is not None:
            yield _series(pa.Table.from_batches([rest]), [rest.num_rows], n, at, vols)

    arrays = "".join(f", {c} array<double>" for c in ("ff", "ret", *vols))
    return paths.mapInArrow(filled, f"entity_id string{arrays}")


def _series(
    table: pa.Table, ends: list[int], n: int, at: Sequence[int], vols: dict[str, tuple[int, bool]]
) -> pa.RecordBatch:
    """The series of whole entities, whose bars, in order, end at the rows ``ends``."""
    close = table["close"].to_numpy()
    row = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
    bar = np.full((len(ends), n), -1)
    bar[row, table["t"].to_numpy()] = np.arange(len(close))
    bar = np.maximum.accumulate(bar, axis=1)  # the last bar by each date
    seen, ff, ret = bar >= 0, close[bar], np.zeros((len(ends), n))
    moved = np.zeros_like(seen)
    moved[:, 1:] = seen[:, :-1] & (ff[:, :-1] != 0)
    with np.errstate(all="ignore"):
        ret[:, 1:] = ff[:, 1:] / ff[:, :-1] - 1.0
        found = [_deviations(ret, moved, at, *spec) for spec in vols.values()]

    def arrays(values: np.ndarray, known: np.ndarray) -> pa.ListArray:
        offsets = pa.array(np.arange(len(ends) + 1) * values.shape[1], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), mask=~known.ravel()))

    names = table["entity_id"].take(pa.array(np.array(ends) - 1)).combine_chunks()
    columns = [names, arrays(ff, seen), arrays(ret, moved), *(arrays(*f) for f in found)]
    return pa.RecordBatch.from_arrays(columns, ["entity_id", "ff", "ret", *vols])


def _deviations(
    ret: np.ndarray, known: np.ndarray, at: Sequence[int], window: int, sample: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Deviation of the ``window`` returns up to each position, updated return by return as Spark does."""
    count, mean, square = np.zeros((3, len(ret), len(at)))
    for back in range(window - 1, -1, -1):
        before = np.asarray(at, dtype=int) - back
        col = np.maximum(before, 0)
        used = known[:, col] & (before >= 0)
        delta = ret[:, col] - mean
        count += used
        step = delta / count
        mean = np.where(used, mean + step, mean)
        square = np.where(used, square + delta * (delta - step), square)
    return np.sqrt(square / (count - 1 if sample else count)), count > (1 if sample else 0)


def momentum_at(lookback: int, skip: int = 0) -> Column:
    """``momentum`` at the position ``t`` of a ``price_series``."""
    return F.try_divide(F.get("ff", F.col("t") - skip), F.get("ff", F.col("t") - lookback)) - 1.0


def mean_reversion_at(lookback: int) -> Column:
    """``mean_reversion`` at the position ``t`` of a ``price_series``."""
    return -(F.try_divide(F.get("ff", F.col("t")), F.get("ff", F.col("t") - lookback)) - 1.0)


def momentum(lookback: int, skip: int = 0) -> Column:
    """Return from ``lookback`` bars ago to ``skip`` bars ago."""
    recent = F.lag("ff", skip).over(by_entity()) if skip else F.col("ff")
    return F.try_divide(recent, F.lag("ff", lookback).over(by_entity())) - 1.0


def mean_reversion(lookback: int) -> Column:
    """Minus the recent return: recent losers score high."""
    return -(F.try_divide(F.col("ff"), F.lag("ff", lookback).over(by_entity())) - 1.0)


def rolling_vol(window: int, sample: bool = False) -> Column:
    """Deviation of the last ``window`` returns (population unless ``sample``)."""
    fn = F.stddev_samp if sample else F.stddev_pop
    return fn("ret").over(by_entity().rowsBetween(-(window - 1), 0))


def trailing_high(window: int = 60) -> Column:
    """Highest raw price over the last ``window`` panel dates."""
    return F.max("px").over(by_entity().rowsBetween(-(window - 1), 0))


def with_forward_returns(
    panel: DataFrame, horizon: int, out: str = "fwd", partial: bool = False
) -> DataFrame:
    """Return over the ``horizon`` bars strictly after each bar.

    Null until all of them exist; with ``partial`` any number of bars from one on will do.
    Bars before an entity's first price count as a zero return.
    """
    whole = W.partitionBy("entity_id")
    start = F.coalesce(F.col("ff"), F.first("ff", ignorenulls=True).over(by_entity().rowsBetween(
        0, W.unboundedFollowing)))
    end = F.lead("ff", horizon).over(by_entity())
    bars_left = F.col("n_dates") - 1 - F.col("t")
    if partial:
        end = F.when(bars_left >= horizon, end).otherwise(F.max_by("ff", "t").over(whole))
        matured = bars_left >= 1
    else:
        matured = bars_left >= horizon
    # No price up to the end of the horizon: every bar of it counted as zero.
    return panel.withColumn(out, F.when(matured, F.coalesce(F.try_divide(end, start) - 1.0, F.lit(0.0))))


def market_return(panel: DataFrame) -> DataFrame:
    """Equal-weighted mean return per date, skipping entities without one."""
    return panel.groupBy("event_time").agg(F.avg("ret").alias("market_ret"))
