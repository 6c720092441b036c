"""Book sizing: volatility target on a shrunk covariance, hard risk limits, selection weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.crosssection import top_k
from pitline.operators.scoring import tilt_weights
from pitline.session import materialize

BOOK = ["strategy", "as_of"]
#: Names of a book that one task adds up.
NAMES_PER_PART = 16_384


@dataclass(frozen=True)
class RiskLimits:
    max_position_weight: float = 0.10
    max_gross_exposure: float = 1.0
    max_net_exposure: float = 1.0
    max_sector_weight: float = 0.30


def return_windows(panel: DataFrame, schedule: DataFrame, lookback: int = 90) -> DataFrame:
    """Trailing returns per (as_of, entity) as ``xs``, only where the window has no gap.

    ``schedule`` is ``(as_of, t)`` with the panel position of each decision time. A name's returns are
    put into one array, of which each decision time takes its slice.
    """
    by_date = F.array_sort(F.collect_list(F.struct("t", "ret")))
    series = panel.select("entity_id", F.col("t").cast("int").alias("t"), "ret").groupBy("entity_id").agg(
        F.transform(by_date, lambda p: p["ret"]).alias("ret")
    )
    at = series.join(schedule.select("as_of", F.col("t").cast("int").alias("t")))
    n_obs, xs = trailing(lookback)
    return at.select("as_of", "entity_id", n_obs.alias("n_obs"), xs.alias("xs")).where(
        F.col("xs").isNotNull()
    )


def trailing(lookback: int = 90) -> tuple[Column, Column]:
    """(number, values) of the last ``lookback`` returns at position ``t`` of a series' ``ret``.

    The first date has no return. The values are null if there are none or if one is missing.
    """
    n = F.least(F.lit(lookback), F.col("t")).cast("int")
    xs = F.slice("ret", F.col("t") - n + 2, F.greatest(n, F.lit(0)))
    whole = (n >= 1) & ~F.exists(xs, lambda x: x.isNull())
    return n, F.when(whole, xs)


GRAMS = "strategy string, as_of timestamp, n_obs int, g array<double>, p array<double>, ww double, n_names long"


def _gram_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per book: date-by-date inner products of the centred returns, summed over a partition.

    Rows of one decision time are adjacent, each with the books that hold the name, so a name's returns
    are read once and books of the same names share a product. One n x n matrix (n = lookback) is held
    per book of a decision time.
    """
    key, books, stamp = None, {}, None

    def flush():
        names, grams, ports, squares, counts = zip(*((name, *sums) for name, sums in books.items()))
        as_of = pa.array([key[0]] * len(names), pa.int64()).cast(stamp)
        arrays = [
            pa.array(names), as_of, pa.array([key[1]] * len(names), pa.int32()),
            pa.array([g.ravel() for g in grams]), pa.array(list(ports)), pa.array(squares, pa.float64()),
            pa.array(counts, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["strategy", "as_of", "n_obs", "g", "p", "ww", "n_names"])

    for batch in batches:
        stamp = batch.column("as_of").type
        times = batch.column("as_of").cast(pa.int64()).to_numpy()
        n_obs = batch.column("n_obs").to_numpy()
        changes = np.flatnonzero((np.diff(times) != 0) | (np.diff(n_obs) != 0)) + 1
        for a, b in zip([0, *changes], [*changes, len(times)]):
            if a == b:
                continue
            found = (int(times[a]), int(n_obs[a]))
            if found != key:
                if books:
                    yield flush()
                key, books = found, {}
            for name, *sums in _products(batch.slice(a, b - a), found[1]):
                books[name] = [x + y for x, y in zip(books[name], sums)] if name in books else sums
    if books:
        yield flush()


def _products(rows: pa.RecordBatch, n: int) -> Iterator[tuple]:
    """``(strategy, products of dates, portfolio, sum of squared weights, names)`` of one decision time."""
    x = pc.list_flatten(rows.column("xs")).to_numpy(zero_copy_only=False).reshape(-1, n)
    x = x - x.mean(axis=1, keepdims=True)
    names = pc.list_flatten(rows.column("names")).dictionary_encode()
    at = names.indices.to_numpy(), pc.list_parent_indices(rows.column("names")).to_numpy()
    held = np.zeros((len(names.dictionary), len(x)), dtype=bool)
    weights = np.zeros(held.shape)
    held[at] = True
    weights[at] = pc.list_flatten(rows.column("weights")).to_numpy(zero_copy_only=False)
    grams = {}
    for name, mine, w in zip(names.dictionary.to_pylist(), held, weights):
        mark = mine.tobytes()
        if mark not in grams:
            grams[mark] = x[mine].T @ x[mine]
        yield name, grams[mark], w @ x, float(w @ w), int(mine.sum())


def _moments(parts: pd.DataFrame) -> pd.DataFrame:
    """The sums of a book's inner products that its risk needs, from a few parts."""
    n = len(parts["p"].iloc[0])
    gram = np.sum(np.stack(parts["g"].to_numpy()), axis=0).reshape(n, n)
    port, diag = np.sum(np.stack(parts["p"].to_numpy()), axis=0), np.diag(gram)
    return pd.DataFrame(
        {"strategy": [parts["strategy"].iloc[0]], "as_of": [parts["as_of"].iloc[0]], "n_obs": [n],
         "n_names": [parts["n_names"].sum()], "ww": [parts["ww"].sum()], "_tr": [diag.sum()],
         "_q2": [diag @ diag], "_g2": [(gram * gram).sum()], "_p2": [port @ port]}
    )


def book_risk(weights: DataFrame, windows: DataFrame, salts: int | None = None) -> DataFrame:
    """Per-period variance of each book under Ledoit-Wolf shrinkage.

    ``(strategy, as_of, n_names, n_obs, variance)``. With X the centred (dates x names) returns,
    the shrunk covariance is (1 - d) S + d m I, and everything it needs comes from the dates'
    inner products X X': no names x names matrix is ever formed.

    ``weights`` is ``(strategy, as_of, entity_id, weight)``; names without a full window count
    with neither weight nor risk. All books are taken together: a name's window travels once per decision
    time, whatever the number of books. The names of a decision time are spread over up to ``salts`` tasks
    (as many as a shuffle has by default), and each sends one dates x dates matrix per book.
    """
    if salts is None:
        salts = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Names that share a salt are summed up in one part, so a small book has few parts.
    sizes = weights.groupBy(*BOOK).agg(F.count(F.lit(1)).alias("_n")).groupBy("as_of").agg(
        F.least(F.lit(salts), F.ceil(F.max("_n") / F.lit(NAMES_PER_PART))).alias("_parts")
    )
    salt = F.pmod(F.xxhash64("entity_id"), F.greatest(F.lit(1), F.col("_parts"))).alias("_salt")
    key = ["as_of", "_salt", "entity_id"]
    sizes = materialize(sizes)
    held = weights.join(sizes, "as_of").select("as_of", salt, "entity_id", "strategy", "weight")
    held = held.repartition("as_of", "_salt").groupBy(*key).agg(
        F.collect_list(F.struct("strategy", F.col("weight").cast("double").alias("weight"))).alias("_books")
    )
    traded = windows.join(sizes, "as_of").select("as_of", salt, "entity_id", "n_obs", "xs")
    rows = traded.repartition("as_of", "_salt").join(held, key)
    parts = (
        rows.select(
            "as_of", "n_obs", "xs", F.transform("_books", lambda b: b["strategy"]).alias("names"),
            F.transform("_books", lambda b: b["weight"]).alias("weights"), "_salt",
        )
        .sortWithinPartitions("as_of", "_salt")
        .drop("_salt")
        .mapInArrow(_gram_parts, GRAMS)
    )
    sums = parts.groupBy(*BOOK).applyInPandas(
        _moments,
        "strategy string, as_of timestamp, n_obs int, n_names long, ww double, _tr double, _q2 double, "
        "_g2 double, _p2 double",
    )
    n, m = F.col("n_obs").cast("double"), F.col("n_names").cast("double")
    trace = F.col("_tr") / n
    mean = trace / m
    frob = F.col("_g2") / (n * n)
    beta = (F.col("_q2") / n - frob) / (m * n)
    delta = (frob - 2.0 * mean * trace + m * mean * mean) / m
    bounded = F.least(beta, delta)
    shrink = F.when(bounded == 0, 0.0).otherwise(bounded / delta)
    variance = (1.0 - shrink) * F.col("_p2") / n + shrink * mean * F.col("ww")
    return sums.select(
        *BOOK, "n_names", "n_obs", variance.alias("variance"), shrink.alias("shrinkage")
    )


def vol_scale(variance: Column, target_vol: float, periods: int = 252) -> Column:
    """Factor that brings a book to the target annual volatility; 1 for a riskless book."""
    annual = F.sqrt(F.greatest(variance, F.lit(0.0)) * periods)
    return F.when(annual > 0, F.lit(target_vol) / annual).otherwise(1.0)


def vol_targeted(
    weights: DataFrame,
    windows: DataFrame,
    target_vol: float = 0.10,
    max_gross: float = 1.0,
    suffix: str = "@vol",
    risk: DataFrame | None = None,
) -> DataFrame:
    """Rescale any book to a volatility target, gross capped; too little history leaves it as is.

    ``risk`` is the books' ``book_risk`` if it is known already; it may hold other books too.
    """
    risk = book_risk(weights, windows) if risk is None else risk
    flagged = weights.join(risk, BOOK, "left").join(
        windows.select("as_of", "entity_id", F.lit(True).alias("_full")),
        ["as_of", "entity_id"],
        "left",
    )
    enough = (F.col("n_names") >= 2) & (F.col("n_obs") >= 20)
    scaled = flagged.withColumn(
        "_w",
        F.when(
            F.coalesce(enough, F.lit(False)),
            F.when(F.col("_full"), F.col("weight") * vol_scale(F.col("variance"), target_vol)),
        ).otherwise(F.col("weight")),
    ).withColumn("_governed", F.coalesce(enough, F.lit(False)))
    gross = scaled.groupBy(*BOOK).agg(F.sum(F.abs("_w")).alias("_gross"))
    capped = F.when(
        F.col("_governed") & (F.col("_gross") > max_gross),
        F.col("_w") * max_gross / F.col("_gross"),
    ).otherwise(F.col("_w"))
    return (
        scaled.join(gross, BOOK)
        .withColumn("weight", capped)
        .where(~F.col("_governed") | (F.abs("weight") > 1e-9))
        .where(F.col("weight").isNotNull())
        .select(F.concat("strategy", F.lit(suffix)).alias("strategy"), "as_of", "entity_id",
                "weight")
    )


def apply_risk_limits(
    weights: DataFrame, limits: RiskLimits = RiskLimits(), sectors: DataFrame | None = None
) -> DataFrame:
    """Clip names, scale gross, scale sectors, trim the dominant side to the net cap; drop zeros.

    Nothing is redistributed after a cut, and a large book is never in one task.
    """
    cap = limits.max_position_weight
    clipped = weights.withColumn(
        "weight", F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("weight")))
    )
    if sectors is not None:
        clipped = clipped.join(sectors.select("entity_id", "sector"), "entity_id", "left")
    else:
        clipped = clipped.withColumn("sector", F.lit(None).cast("string"))
    # Every cut scales a whole sector or side, so all factors follow from the long and short sums
    # per (book, sector): one aggregation of the book and one join back.
    no_sector = F.coalesce("sector", F.lit("\0"))
    clipped = clipped.withColumn("sector", no_sector)
    sums = clipped.groupBy(*BOOK, "sector").agg(
        F.sum(F.greatest(F.col("weight"), F.lit(0.0))).alias("_l"),
        F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).alias("_s"),
    )
    book = W.partitionBy(*BOOK)  # one row per sector
    gross = F.sum(F.col("_l") + F.col("_s")).over(book)
    sums = sums.withColumn(
        "_f",
        F.when(gross > limits.max_gross_exposure, limits.max_gross_exposure / gross).otherwise(1.0),
    )
    exposure = F.col("_f") * (F.col("_l") + F.col("_s"))
    over = (F.col("sector") != "\0") & (exposure > limits.max_sector_weight)
    sums = sums.withColumn(
        "_f", F.when(over, F.col("_f") * limits.max_sector_weight / exposure).otherwise(F.col("_f"))
    )
    longs = F.sum(F.col("_f") * F.col("_l")).over(book)
    shorts = F.sum(F.col("_f") * F.col("_s")).over(book)
    excess = F.abs(longs - shorts) - limits.max_net_exposure

    def trimmed(dominant: Column, side: Column) -> Column:
        return F.when(dominant & (excess > 1e-12), F.col("_f") * (1.0 - excess / side)).otherwise(
            F.col("_f")
        )

    factors = sums.select(
        *BOOK, "sector",
        trimmed(longs > shorts, longs).alias("_fl"), trimmed(shorts > longs, shorts).alias("_fs"),
    )
    final = F.col("weight") * F.when(F.col("weight") > 0, F.col("_fl")).otherwise(F.col("_fs"))
    return (
        clipped.join(factors, [*BOOK, "sector"])
        .select("strategy", "as_of", "entity_id", final.alias("weight"))
        .where(F.col("weight") != 0)
    )


def limit_breaches(targets: DataFrame, limits: RiskLimits = RiskLimits()) -> DataFrame:
    """Names whose order must be refused, with the first limit each would breach."""
    totals = targets.groupBy(*BOOK).agg(
        F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net")
    )
    reason = (
        F.when(F.abs("weight") > limits.max_position_weight + 1e-9, "position")
        .when(F.col("gross") > limits.max_gross_exposure + 1e-9, "gross")
        .when(F.abs("net") > limits.max_net_exposure + 1e-9, "net")
    )
    return (
        targets.join(totals, BOOK)
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(*BOOK, "entity_id", "weight", "reason")
    )


def exposures(weights: DataFrame) -> DataFrame:
    """Gross, net and short notional per book."""
    return weights.groupBy(*BOOK).agg(
        F.sum(F.abs("weight")).alias("gross"),
        F.sum("weight").alias("net"),
        F.sum(F.greatest(-F.col("weight"), F.lit(0.0))).alias("short_notional"),
    )


def size_book(
    tradable: DataFrame,
    windows: DataFrame,
    *,
    target_vol: float = 0.10,
    limits: RiskLimits = RiskLimits(),
    tilt_strength: float = 0.0,
    regime_derisk: float = 1.0,
    sectors: DataFrame | None = None,
    strategy: str = "sized",
) -> DataFrame:
    """Scores to a risk-managed book over all decision times.

    ``tradable`` is ``(as_of, entity_id, score)``, score null or absent for 1/n. Names without a
    full return window are dropped; with fewer than 2 such names or 20 returns the tilted book
    stays ungoverned.
    """
    scored = tradable if "score" in tradable.columns else tradable.withColumn(
        "score", F.lit(None).cast("double")
    )
    rows = unsized(scored, windows, tilt_strength, strategy)
    risk = book_risk(held_names(rows), windows)
    return sized(rows, risk, target_vol, limits, regime_derisk, sectors)


def unsized(
    scored: DataFrame, windows: DataFrame, tilt_strength: float = 0.0, strategy: str = "sized"
) -> DataFrame:
    """The tilted book of ``size_book`` before it is sized, with what its names with a window add up to."""
    raw = tilt_weights(scored, tilt_strength).withColumn("strategy", F.lit(strategy))
    full = windows.select("as_of", "entity_id", "n_obs").withColumn("_full", F.lit(True))
    rows = raw.join(full, ["as_of", "entity_id"], "left")
    held = rows.groupBy(*BOOK).agg(
        F.sum(F.when(F.col("_full"), F.col("weight"))).alias("_held"),
        F.count(F.when(F.col("_full"), 1)).alias("_n"),
        F.max("n_obs").alias("_obs"),
    )
    # Used by the governed and the cold branch and in the risk: written once.
    return materialize(rows.drop("n_obs").join(held, BOOK))


def _governed() -> Column:
    return (F.col("_n") >= 2) & (F.col("_obs") >= 20)


def held_names(rows: DataFrame) -> DataFrame:
    """The governed books of ``unsized`` rows, reduced to names with a window, at unit sum."""
    return rows.where(_governed() & F.col("_full")).select(
        "strategy", "as_of", "entity_id", (F.col("weight") / F.col("_held")).alias("weight")
    )


def sized(
    rows: DataFrame, risk: DataFrame, target_vol: float = 0.10, limits: RiskLimits = RiskLimits(),
    regime_derisk: float = 1.0, sectors: DataFrame | None = None,
) -> DataFrame:
    """``unsized`` rows, of one or more books, at the target under ``risk``, the ``book_risk`` of their names."""
    budget = target_vol * max(0.0, regime_derisk)
    at_target = held_names(rows).join(risk.select(*BOOK, "variance"), BOOK).withColumn(
        "weight", F.col("weight") * vol_scale(F.col("variance"), budget)
    ).drop("variance")
    cold = rows.where(~F.coalesce(_governed(), F.lit(False))).select(
        "strategy", "as_of", "entity_id",
        (F.col("weight") * max(0.0, regime_derisk)).alias("weight"),
    )
    book = at_target.unionByName(cold).where(F.abs("weight") > 1e-9)
    return apply_risk_limits(book, limits, sectors)


def selection_weights(selected: DataFrame, mode: str = "equal") -> DataFrame:
    """Weights of selected names: ``equal``, ``inverse_vol`` (column vol) or ``conviction`` (score).

    A missing volatility takes the mean inverse volatility of the book; conviction is the score
    above the weakest plus a tenth of the strongest.
    """
    if mode == "inverse_vol":
        inv = F.when(F.col("vol") > 0, 1.0 / F.col("vol"))
        stats = selected.groupBy(*BOOK).agg(
            F.avg(inv).alias("_mean"), F.sum(inv).alias("_sum"), F.count(inv).alias("_k"),
            F.count(F.lit(1)).alias("_n"),
        )
        total = F.col("_sum") + F.col("_mean") * (F.col("_n") - F.col("_k"))
        weight = F.when(total > 0, F.coalesce(inv, F.col("_mean")) / total)
    elif mode == "conviction":
        score = F.coalesce(F.col("score"), F.lit(0.0))
        stats = selected.groupBy(*BOOK).agg(
            F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.sum(score).alias("_sum"),
            F.count(F.lit(1)).alias("_n"),
        )
        span = F.col("_hi") - F.col("_lo")
        floor = F.when(span > 0, span * 0.10).otherwise(1.0)
        total = F.col("_sum") + F.col("_n") * (floor - F.col("_lo"))
        weight = F.when(total > 0, (score - F.col("_lo") + floor) / total)
    elif mode == "equal":
        stats = selected.groupBy(*BOOK).agg(F.count(F.lit(1)).alias("_n"))
        weight = F.lit(None).cast("double")
    else:
        raise ValueError(f"unknown weighting: {mode}")
    return selected.join(stats, BOOK).select(
        "strategy", "as_of", "entity_id",
        F.coalesce(weight, 1.0 / F.col("_n")).alias("weight"),
    )


# --- covariance by tiles ------------------------------------------------------------------------

#: Names of a block, about; a tile holds the pairs of two blocks.
TILE = 1024
#: Dates of a piece of a name's returns, about.
DATES = 512
#: Names of the left block whose pairs are handed on together.
EMITTED = 64
COVARIANCES = pa.schema(
    [("grp", pa.string()), ("a", pa.string()), ("b", pa.string()), ("cov", pa.float64())]
)


class _Tile:
    """Counts and sums of the pairs of two blocks of names, added up over pieces of the dates."""

    def __init__(self, grp: str, diagonal: bool):
        self.grp, self.diagonal = grp, diagonal
        self.index = ({}, {})
        self.sums = np.zeros((5, 0, 0))

    def add(self, rows: list) -> None:
        """Adds the ``(side, name, dates, returns)`` of one piece of the dates."""
        dates = np.unique(np.concatenate([r[2] for r in rows]))
        sides = []
        for side, index in enumerate(self.index):
            mine = rows if self.diagonal else [r for r in rows if r[0] == side]
            at = np.array([index.setdefault(r[1], len(index)) for r in mine], dtype=int)
            x, seen = np.zeros((2, len(mine), len(dates)))
            for i, (_, _, t, ret) in enumerate(mine):
                col = np.searchsorted(dates, t)
                x[i, col], seen[i, col] = ret, 1.0
            odd = ~np.isfinite(x)
            sides.append((at, np.where(odd, 0.0, x), seen, odd.astype(float)))
        shape = [len(index) for index in self.index]
        grown = [(0, 0), *((0, n - old) for n, old in zip(shape, self.sums.shape[1:]))]
        self.sums = np.pad(self.sums, grown)
        (at, x, seen, odd), (at2, y, seen2, odd2) = sides
        cells = np.ix_(at, at2)
        parts = (seen @ seen2.T, x @ seen2.T, seen @ y.T, x @ y.T, odd @ seen2.T + seen @ odd2.T)
        for total, part in zip(self.sums, parts):
            total[cells] += part

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The covariances of the tile, each pair both ways."""
        names, names2 = (pa.array(list(index), pa.string()) for index in self.index)
        for at in range(0, len(names), EMITTED):
            n, sx, sy, sxy, odd = self.sums[:, at : at + EMITTED]
            i, j = np.nonzero(n > 1)
            n, sx, sy, sxy, odd = (m[i, j] for m in (n, sx, sy, sxy, odd))
            cov = pa.array(np.where(odd > 0, np.nan, (sxy - sx * sy / n) / (n - 1)))
            left, right, grp = names.take(pa.array(i + at)), names2.take(pa.array(j)), pa.array([self.grp] * len(i), pa.string())
            yield pa.RecordBatch.from_arrays([grp, left, right, cov], schema=COVARIANCES)
            if not self.diagonal:
                yield pa.RecordBatch.from_arrays([grp, right, left, cov], schema=COVARIANCES)


def _tile_covariances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covariances of each tile; rows come tile by tile and piece by piece of the dates."""
    key, tile, rows = None, None, []
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("grp", "i", "j", "piece", "side", "entity_id")}
        series = []
        for c in ("ts", "rets"):
            lists = batch.column(c)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            series.append([flat[a:b] for a, b in zip(ends[:-1], ends[1:])])
        for *found, side, name, t, ret in zip(*cols.values(), *series):
            if found != key:
                if rows:
                    tile.add(rows)
                    rows = []
                if key is None or found[:3] != key[:3]:
                    if tile is not None:
                        yield from tile.batches()
                    tile = _Tile(found[0], found[1] == found[2])
                key = found
            rows.append((side, name, t, ret))
    if rows:
        tile.add(rows)
        yield from tile.batches()


def pairwise_covariance(returns: DataFrame, tasks: int | None = None, tile: int = TILE) -> DataFrame:
    """Sample covariance of the names of each group, ``(grp, a, b, cov)``.

    ``returns`` is ``(grp, t, entity_id, ret)``; pairs use the dates both names have. The names of a group
    are cut into blocks of about ``tile``, and each pair of blocks is a tile. Names travel to the tiles of
    their block as arrays; one task takes all dates of a tile, piece by piece, as products of matrices and
    emits its covariances. So a task holds one tile, however many names a group has, a group's tiles
    are spread over ``tasks``, and no pair is ever shuffled or written on the way.
    """
    if tasks is None:
        tasks = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    returns = returns.where(F.col("ret").isNotNull()).select("grp", "t", "entity_id", F.col("ret").cast("double"))
    returns = materialize(returns)
    blocks = returns.groupBy("grp").agg(
        F.greatest(F.lit(1), F.ceil(F.approx_count_distinct("entity_id") / tile)).cast("int").alias("_nb"),
        F.greatest(F.lit(1), F.ceil(F.approx_count_distinct("t") / DATES)).cast("int").alias("_nd"),
    )
    by_date = F.array_sort(F.collect_list(F.struct("t", "ret")))
    series = (
        returns.join(blocks, "grp")
        .withColumn("piece", F.pmod(F.xxhash64("t"), F.col("_nd")).cast("int"))
        .groupBy("grp", "entity_id", "piece", "_nb").agg(by_date.alias("_v"))
        .withColumn("_b", F.pmod(F.xxhash64("entity_id"), F.col("_nb")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    )
    tiles = series.select(
        "grp", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), "piece",
        (F.col("_b") > F.col("_o")).cast("int").alias("side"), "entity_id",
        F.transform("_v", lambda v: v["t"]).alias("ts"), F.transform("_v", lambda v: v["ret"]).alias("rets"),
    )
    return (
        tiles.repartition(tasks, "grp", "i", "j")
        .sortWithinPartitions("grp", "i", "j", "piece")
        .mapInArrow(_tile_covariances, "grp string, a string, b string, cov double")
    )


def top_names(scores: DataFrame, k: int, descending: bool = True) -> DataFrame:
    """First ``k`` names per decision time by score, ties by name."""
    order = F.col("score").desc() if descending else F.col("score").asc()
    return top_k(scores.where(F.col("score").isNotNull()), ["as_of"], k, order, F.col("entity_id"))
