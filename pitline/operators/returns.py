"""Return accounting for weight tables, performance metrics, bootstraps.

All strategies and all dates run together: the key is ``(strategy, as_of, entity_id)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.crosssection import compounded
from pitline.functions.scalars import whole_days
from pitline.functions.timeline import Slots

TRADING_DAYS = 252


@dataclass(frozen=True)
class Costs:
    """Costs as column functions of turnover and of short notional held for some days."""

    commission_bps: float = 1.0
    half_spread_bps: float = 2.0
    slippage_bps: float = 1.0
    annual_borrow_bps: float = 0.0

    def turnover_cost(self, turnover: Column) -> Column:
        return turnover * ((self.commission_bps + self.half_spread_bps + self.slippage_bps) * 1e-4)

    def holding_cost(self, short_notional: Column, days: Column) -> Column:
        return short_notional * (self.annual_borrow_bps * 1e-4) * (days / 365.0)


BASIC = Costs()
BORROW = Costs(annual_borrow_bps=50.0)
FREE = Costs(0.0, 0.0, 0.0)


def turnover(weights: DataFrame, slots: Slots) -> DataFrame:
    """Sum of absolute weight changes per ``(strategy, k)``, where anything changed.

    A weight enters at its own rebalance and leaves at the next one, so the change is a sum of
    signed copies and no self-join is needed.
    """
    # A name has few rows, a book and decision time each, so they are shuffled before they are doubled.
    moves = in_force(weights, slots).repartition("entity_id").select(
        "strategy",
        "entity_id",
        F.explode(
            F.array(
                F.struct(F.col("k").alias("k"), F.col("weight").alias("w")),
                F.struct((F.col("k") + 1).alias("k"), (-F.col("weight")).alias("w")),
            )
        ).alias("m"),
    ).where(F.col("m.k") < slots.n)
    per_name = moves.groupBy("strategy", "entity_id", F.col("m.k").alias("k")).agg(
        F.sum("m.w").alias("d")
    )
    return per_name.groupBy("strategy", "k").agg(F.sum(F.abs("d")).alias("turnover"))


def in_force(weights: DataFrame, slots: Slots) -> DataFrame:
    """The weights by the number ``k`` of their rebalance."""
    return weights.join(slots.schedule.select("as_of", "k"), "as_of").select(
        "strategy", "k", "entity_id", "weight"
    )


def rebalance_costs(weights: DataFrame, slots: Slots, end, costs: Costs = BASIC) -> DataFrame:
    """``(strategy, k, turnover, cost)``; ``end`` closes the last holding period."""
    moved = turnover(weights, slots)
    shorts = (
        weights.where(F.col("weight") < 0)
        .join(slots.schedule.select("as_of", "k"), "as_of")
        .groupBy("strategy", "k")
        .agg(F.sum(-F.col("weight")).alias("_short"))
    )
    held = slots.schedule.select(
        "k",
        F.greatest(
            F.lit(0), whole_days(F.coalesce(F.col("next_as_of"), end), F.col("as_of"))
        ).alias("_days"),
    )
    both = moved.join(shorts, ["strategy", "k"], "full").join(held, "k")
    traded = F.coalesce(F.col("turnover"), F.lit(0.0))
    short = F.coalesce(F.col("_short"), F.lit(0.0))
    return both.select(
        "strategy", "k", traded.alias("turnover"),
        (costs.turnover_cost(traded) + costs.holding_cost(short, F.col("_days"))).alias("cost"),
    )


def return_table(
    weights: DataFrame,
    panel: DataFrame,
    slots: Slots,
    costs: Costs = BASIC,
    strategies: list[str] | None = None,
) -> DataFrame:
    """``(strategy, event_time, k, gross, cost, net, turnover)`` for every bar after the first
    rebalance.

    A bar belongs to the last rebalance strictly before it. Costs fall on the first bar after a
    rebalance; without such a bar there is no cost. A weight without a return earns nothing.
    """
    placed = _bars(panel.select("event_time").distinct(), slots)
    moved = panel.where(F.col("ret").isNotNull()).join(placed, "event_time")
    gross = (
        moved.join(in_force(weights, slots), ["k", "entity_id"])
        .groupBy("strategy", "event_time")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"))
    )
    last = panel.agg(F.max("event_time")).scalar()
    return _accounts(weights, placed, gross, last, slots, costs, strategies)


def path_returns(
    weights: DataFrame, paths: DataFrame, calendar: DataFrame, slots: Slots, costs: Costs = BASIC
) -> DataFrame:
    """``return_table`` from ``(k, entity_id, path)``: a name's returns of the bars after rebalance ``k``, in order.

    ``calendar`` is ``(event_time, t)`` of all bars. Both sides are dealt by the name, which has a row per
    rebalance and book, so no return is shuffled more than once.
    """
    placed = _bars(calendar, slots)
    held = in_force(weights, slots).repartition("entity_id")
    gross = (
        held.join(paths.repartition("entity_id"), ["k", "entity_id"])
        .select("strategy", "k", "weight", F.posexplode("path").alias("_bar", "ret"))
        .where(F.col("ret").isNotNull())
        .groupBy("strategy", "k", "_bar")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"))
        .join(placed.select("event_time", "k", "_bar"), ["k", "_bar"])
        .select("strategy", "event_time", "gross")
    )
    last = calendar.agg(F.max("event_time")).scalar()
    return _accounts(weights, placed, gross, last, slots, costs)


def _bars(dates: DataFrame, slots: Slots) -> DataFrame:
    """``(event_time, k, _bar, _first)``: the bars after each rebalance, numbered from 0."""
    placed = slots.assign(dates.select("event_time"), "event_time", "_slot").where(F.col("_slot") > 0)
    number = F.row_number().over(W.partitionBy("k").orderBy("event_time")) - 1
    return placed.select("event_time", (F.col("_slot") - 1).alias("k")).select(
        "event_time", "k", number.alias("_bar"), (number == 0).alias("_first")
    )


def _accounts(
    weights: DataFrame, placed: DataFrame, gross: DataFrame, last, slots: Slots, costs: Costs,
    strategies: list[str] | None = None,
) -> DataFrame:
    """The return table of all strategies and bars, given what the strategies earned before costs."""
    if strategies is None:
        names = weights.agg(F.collect_set("strategy")).scalar()
    else:
        names = F.array(*[F.lit(s) for s in strategies])
    rows = placed.withColumn("strategy", F.explode(names))
    charged = rebalance_costs(weights, slots, last, costs).withColumn("_first", F.lit(True))
    out = rows.join(gross, ["strategy", "event_time"], "left").join(
        charged, ["strategy", "k", "_first"], "left"
    )
    g, c = (F.coalesce(F.col(x), F.lit(0.0)) for x in ("gross", "cost"))
    return out.select(
        "strategy", "event_time", "k", g.alias("gross"), c.alias("cost"), (g - c).alias("net"),
        "turnover",
    )


def buy_and_hold(panel: DataFrame, start_after: Column | None = None) -> DataFrame:
    """Returns of an equal-weighted portfolio that is never rebalanced, first bar 0."""
    rows = panel if start_after is None else panel.where(F.col("event_time") > start_after)
    path = W.partitionBy("entity_id").orderBy("event_time").rowsBetween(W.unboundedPreceding, 0)
    equity = rows.withColumn("_eq", compounded("ret", path))
    mean = equity.groupBy("event_time").agg(F.avg("_eq").alias("_eq"))
    change = F.try_divide(F.col("_eq"), F.lag("_eq").over(W.orderBy("event_time"))) - 1.0
    return mean.select(
        F.lit("buy_and_hold").alias("strategy"), "event_time",
        F.coalesce(change, F.lit(0.0)).alias("net"),
    )


def equity_curve(returns: DataFrame, by: str = "strategy", ret: str = "net") -> DataFrame:
    """Equity, running peak and drawdown. The peak starts at the first equity value."""
    path = W.partitionBy(by).orderBy("event_time").rowsBetween(W.unboundedPreceding, 0)
    eq = returns.withColumn("equity", compounded(ret, path))
    eq = eq.withColumn("peak", F.max("equity").over(path))
    return eq.withColumn("drawdown", F.try_divide("equity", "peak") - 1.0)


def summarize(
    returns: DataFrame,
    by: str = "strategy",
    ret: str = "net",
    periods: int = TRADING_DAYS,
    rf: float = 0.0,
    no_loss: float | None = 0.0,
) -> DataFrame:
    """Performance summary per group; degenerate inputs give 0 (a wiped-out book -1).

    ``no_loss`` is the Sortino ratio of a group that never lost, null if it shall count as undefined.
    """
    eq = equity_curve(returns.where(F.col(ret).isNotNull()), by, ret)
    x = F.col(ret) - rf / periods
    stats = eq.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_periods"),
        compounded(ret).alias("_total"),
        F.stddev_samp(x).alias("_sd"),
        F.avg(x).alias("_mean"),
        F.avg(F.when(x < 0, x * x)).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"),
    )
    root = float(periods) ** 0.5
    n = F.col("n_periods")
    annual = F.when(F.col("_total") <= 0, -1.0).otherwise(
        F.pow(F.col("_total"), F.lit(float(periods)) / n) - 1.0
    )
    sd, down = F.col("_sd"), F.sqrt("_down")
    ok = n >= 2
    undefined = F.lit(no_loss).cast("double")
    return stats.select(
        by,
        "n_periods",
        annual.alias("ann_return"),
        F.when(ok, sd * root).otherwise(0.0).alias("ann_vol"),
        F.when(ok & (sd > 0), F.col("_mean") / sd * root).otherwise(0.0).alias("sharpe"),
        F.when(ok & (down > 0), F.col("_mean") / down * root).when(ok, undefined).otherwise(0.0).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, annual / F.abs("max_drawdown")).otherwise(0.0)
        .alias("calmar"),
        F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"),
        "hit_rate",
    )


def compare(
    returns: DataFrame, n_rebalances: int, periods: int = TRADING_DAYS, no_loss: float | None = 0.0
) -> DataFrame:
    """Summaries of many strategies in one table, with the mean turnover per rebalance."""
    moved = returns.groupBy("strategy").agg(
        (F.coalesce(F.sum("turnover"), F.lit(0.0)) / n_rebalances).alias("avg_turnover")
    )
    return summarize(returns, periods=periods, no_loss=no_loss).join(moved, "strategy")


def latching_breaker(
    equity: DataFrame, max_drawdown: float = 0.20, seed_peak: float | None = None,
    by: str = "strategy",
) -> DataFrame:
    """High-water mark and a halt flag that stays set once the drawdown limit is reached."""
    path = W.partitionBy(by).orderBy("event_time").rowsBetween(W.unboundedPreceding, 0)
    peak = F.max("equity").over(path)
    if seed_peak is not None:
        peak = F.greatest(peak, F.lit(float(seed_peak)))
    marked = equity.withColumn("peak", peak)
    hit = F.when(
        (F.col("peak") > 0) & (F.try_divide("equity", "peak") - 1.0 <= -max_drawdown), 1
    ).otherwise(0)
    return marked.withColumn("tripped", F.max(hit).over(path) == 1)


def halt_flags(accounts: DataFrame, max_daily_loss: float) -> DataFrame:
    """Flag days whose return against the previous close reached the loss limit (0 disables)."""
    day = F.try_divide("equity", "last_equity") - 1.0
    hit = (F.col("last_equity") > 0) & (day <= -max_daily_loss)
    return accounts.withColumn("halted", hit if max_daily_loss > 0 else F.lit(False))


# --- resampling ------------------------------------------------------------------------------


def draw(modulus: Column, *parts) -> Column:
    """Reproducible uniform draw in [0, modulus) from the identity of the draw.

    It depends on the parts only, never on partitioning.
    """
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), modulus)


def resample(
    returns: DataFrame, n_sims: int, block: int, seed: int = 0, by: str = "strategy",
    ret: str = "net",
) -> DataFrame:
    """Circular block bootstrap: ``(by, sim, path)``, the returns of each simulation in order.

    Each simulation draws ceil(n / block) block starts; positions wrap around. A strategy's returns,
    one per period, travel as one array, so a simulation is one row and nothing of it is shuffled
    but its result.
    """
    known = returns.where(F.col(ret).isNotNull())
    history = known.groupBy(by).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("event_time", F.col(ret).alias("r")))),
            lambda s: s["r"].cast("double"),
        ).alias("_rets")
    )
    n = F.size("_rets")
    size = F.greatest(F.lit(1), F.least(F.lit(block), n)).cast("int")
    tasks = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = (
        history.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))
        .repartition(tasks, by, "sim")
        .withColumns({"_n": n, "_block": size})
        .withColumn("_wrapped", F.concat("_rets", F.slice("_rets", 1, F.col("_block") - 1)))
    )
    # One draw per block; a block that runs over the end goes on in the copy of the first returns.
    begin = lambda i: draw(F.col("_n"), seed, F.col("sim").cast("string"), i.cast("string"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(F.col("_n") / F.col("_block")).cast("int") - 1),
        lambda i: F.slice("_wrapped", begin(i).cast("int") + 1, F.col("_block")),
    )
    path = F.slice(F.flatten(blocks), 1, F.col("_n"))
    return plan.select(by, "sim", path.alias("path"))


def _added(values: Column, start=0.0) -> Column:
    return F.aggregate(values, F.lit(start), lambda a, v: a + v)


def _per_path(paths: DataFrame, by: str, periods: int) -> DataFrame:
    """``summarize`` of every path, by sums over its array, with its total return."""
    root, p = float(periods) ** 0.5, F.col("path")
    zero = F.lit(0.0)
    walked = F.aggregate(
        p,
        F.struct(F.lit(1.0).alias("eq"), zero.alias("peak"), zero.alias("low")),
        lambda a, r: F.struct(
            (a["eq"] * (1.0 + r)).alias("eq"),
            F.greatest(a["peak"], a["eq"] * (1.0 + r)).alias("peak"),
            F.least(
                a["low"],
                F.coalesce(
                    F.try_divide(
                        a["eq"] * (1.0 + r), F.greatest(a["peak"], a["eq"] * (1.0 + r))
                    ) - 1.0,
                    zero,
                ),
            ).alias("low"),
        ),
    )
    n = F.size(p)
    one = paths.withColumns({"n_periods": n.cast("long"), "_walk": walked, "_mean": _added(p) / n})
    falls = F.filter(p, lambda r: r < 0)
    one = one.withColumns(
        {
            "_sd": F.when(
                n >= 2,
                F.sqrt(_added(F.transform(p, lambda r: F.pow(r - F.col("_mean"), 2))) / (n - 1)),
            ),
            "_down": F.sqrt(F.try_divide(_added(F.transform(falls, lambda r: r * r)), F.size(falls))),
            "_total": F.col("_walk.eq"),
            "max_drawdown": F.col("_walk.low"),
            "hit_rate": F.size(F.filter(p, lambda r: r > 0)) / n,
        }
    )
    annual = F.when(F.col("_total") <= 0, -1.0).otherwise(
        F.pow("_total", F.lit(float(periods)) / F.col("n_periods")) - 1.0
    )
    ok, sd, down = F.col("n_periods") >= 2, F.col("_sd"), F.col("_down")
    return one.select(
        by, "sim", "n_periods", annual.alias("ann_return"),
        F.when(ok, sd * root).otherwise(0.0).alias("ann_vol"),
        F.when(ok & (sd > 0), F.col("_mean") / sd * root).otherwise(0.0).alias("sharpe"),
        F.when(ok & (down > 0), F.col("_mean") / down * root).otherwise(0.0).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, annual / F.abs("max_drawdown")).otherwise(0.0)
        .alias("calmar"),
        "max_drawdown", "hit_rate", (F.col("_total") - 1.0).alias("total_return"),
    )


def monte_carlo(
    returns: DataFrame, n_sims: int = 2000, block: int = 10, seed: int = 0, by: str = "strategy",
    periods: int = TRADING_DAYS,
) -> DataFrame:
    """Distribution of terminal return, drawdown and Sharpe over resampled paths."""
    per = _per_path(resample(returns, n_sims, block, seed, by), by, periods)
    return per.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_sims"),
        F.percentile("total_return", F.lit(0.05)).alias("total_return_q05"),
        F.percentile("total_return", F.lit(0.50)).alias("total_return_q50"),
        F.percentile("total_return", F.lit(0.95)).alias("total_return_q95"),
        F.percentile("max_drawdown", F.lit(0.05)).alias("max_drawdown_q05"),
        F.percentile("max_drawdown", F.lit(0.50)).alias("max_drawdown_q50"),
        F.percentile("sharpe", F.lit(0.50)).alias("sharpe_q50"),
        F.avg((F.col("total_return") > 0).cast("double")).alias("prob_positive"),
    )


def bootstrap_ci(
    returns: DataFrame, statistic: str | Callable = "sharpe", n_boot: int = 1000,
    alpha: float = 0.05, seed: int = 0, by: str = "strategy", periods: int = TRADING_DAYS,
) -> DataFrame:
    """Percentile interval of a statistic: a column of ``summarize`` or a function of a path.

    A function receives the array of a path's returns and gives a ``Column``.
    """
    paths = resample(returns, n_boot, 1, seed, by)
    if callable(statistic):
        per = paths.select(by, statistic(F.col("path")).alias("_stat"))
    else:
        per = _per_path(paths, by, periods).withColumn("_stat", F.col(statistic))
    return per.groupBy(by).agg(
        F.percentile("_stat", F.lit(alpha / 2)).alias("low"),
        F.percentile("_stat", F.lit(1 - alpha / 2)).alias("high"),
    )


def brier(probability: str = "probability", outcome: str = "outcome") -> Column:
    """Mean squared error of a probability."""
    return F.avg(F.pow(F.col(probability) - F.col(outcome), 2))


def reliability(
    scored: DataFrame, n_bins: int = 10, probability: str = "probability", outcome: str = "outcome"
) -> DataFrame:
    """Predicted against realised frequency in equal bins; empty bins are listed with nulls."""
    edges = [i / n_bins for i in range(1, n_bins)]
    bin_no = sum([F.when(F.col(probability) >= e, 1).otherwise(0) for e in edges], F.lit(0))
    filled = scored.groupBy(bin_no.alias("bin")).agg(
        F.avg(probability).alias("mean_pred"),
        F.avg(outcome).alias("frac_pos"),
        F.count(F.lit(1)).alias("n"),
    )
    bins = scored.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(filled, "bin", "left").select(
        "bin",
        (F.col("bin") / n_bins).alias("bin_lower"),
        ((F.col("bin") + 1) / n_bins).alias("bin_upper"),
        "mean_pred",
        "frac_pos",
        F.coalesce("n", F.lit(0)).alias("n"),
    )
