"""End-to-end jobs composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.timeline import Slots, calendar_of, make_schedule, sample_dates
from pitline.operators import features as ft
from pitline.operators import grading as gr
from pitline.operators import panel as pn
from pitline.operators import returns as rt
from pitline.operators import scoring as sc
from pitline.operators import signal_ic as si
from pitline.operators import sizing as sz
from pitline.operators import strategies as st
from pitline.operators import study as sd
from pitline.operators import universe as un
from pitline.session import materialize


def grading_slots(panel: DataFrame, slots: Slots, horizon: int) -> DataFrame:
    """``(as_of, matured_k)``: the rebalance at which predictions of each decision time mature."""
    stamps = materialize(panel.select("event_time", "t").distinct())
    made = slots.schedule.select(F.col("as_of")).join(
        stamps.withColumnRenamed("event_time", "as_of"), "as_of"
    )
    ready = made.select("as_of", (F.col("t") + horizon).alias("t")).join(stamps, "t")
    placed = slots.assign(ready, "event_time", "matured_k").where(F.col("matured_k") < slots.n)
    return placed.select("as_of", "matured_k")


def learning_replay(
    bars: DataFrame,
    names: Sequence[str],
    *,
    warmup: int = 60,
    every: int = 20,
    horizon: int = 21,
    min_abs_ic: float = 0.02,
    tilt_strength: float = 1.0,
    target_vol: float = 0.10,
    limits: sz.RiskLimits = sz.RiskLimits(),
) -> tuple[DataFrame, DataFrame]:
    """(net returns per date, measured IC per rebalance and signal) of the learning book.

    What is learned depends on features and later returns only, never on earlier weights, so all
    rebalances are computed together: features, then the IC measured so far at each rebalance,
    then IC-weighted scores, then sized books, then returns.
    """
    names = list(names)
    bars = materialize(bars)
    panel = pn.dense_panel(bars)
    slots = Slots(sample_dates(bars.select("event_time"), warmup=warmup, every=every))
    rows = pn.with_forward_returns(ft.price_features(panel, names), horizon)
    at = materialize(st.at_decisions(rows, slots.schedule))

    known = st.tradable(at)
    empty = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])
        ),
        lambda _, v: v.isNotNull(),
    )
    log = known.select("as_of", "entity_id", empty.alias("features"),
                       F.col("fwd").alias("realized_return"))
    log = log.where(F.col("realized_return").isNotNull())
    graded = log.join(grading_slots(panel, slots, horizon), "as_of")
    history = materialize(slots.with_as_of(gr.expanding_ic(graded, "matured_k", slots.schedule)))

    weights = materialize(sc.ic_weights(history, ["as_of"], min_abs=min_abs_ic))
    matrix = known.select("as_of", "entity_id", *names)
    scores = materialize(sc.composite(matrix, names, weights))
    windows = materialize(
        sz.return_windows(panel, st.schedule_positions(panel, slots.schedule))
    )
    book = materialize(
        st.sized_book(at, windows, scores, target_vol, limits, tilt_strength, "replay")
    )
    net = rt.return_table(book, panel, slots, rt.BASIC, ["replay"])
    return net, history


def compare_strategies(
    bars: DataFrame,
    filings: DataFrame,
    *,
    warmup: int = 60,
    every: int = 20,
    costs: rt.Costs = rt.BASIC,
    n_sims: int = 0,
) -> tuple[DataFrame, DataFrame | None]:
    """(summary per strategy, resampled distribution or None) of the strategy set and baselines.

    All books are unioned into one weight table and accounted in one pass.
    """
    slots = Slots(sample_dates(bars.select("event_time"), warmup=warmup, every=every))
    calendar = materialize(calendar_of(bars.where(F.col("close").isNotNull())).coalesce(1))
    rows = _decision_rows(bars, calendar, slots)
    at = rows.drop("k", "n_obs", "xs", "path")
    windows = rows.where(F.col("xs").isNotNull()).select("as_of", "entity_id", "n_obs", "xs")
    buys = materialize(
        ft.insider_net_buys(filings, slots, 90, opportunistic=True).withColumnRenamed(
            "insider_net_buys_90d_opp", "score"
        ).withColumn("score", F.col("score").cast("double"))
    )
    universe = at.select("as_of", "entity_id", "mom_252_skip21", "lowvol_120")
    stack = ft.feature_matrix(universe, [buys], ["score"])
    stacked = materialize(sc.mean_composite(stack, ["mom_252_skip21", "lowvol_120", "score"]))
    unsized = sz.unsized(st.with_scores(at, None), windows).unionByName(
        sz.unsized(st.with_scores(at, stacked), windows, 1.0, "sized_tilt")
    )
    books = [
        st.equal_weight(at),
        st.momentum(at, 20),
        st.price_composite(at),
        st.price_composite(at, buys, name="composite+insider"),
        st.long_short(at, buys),
        st.long_buyers(at, buys),
        st.top_scores(at, stacked),
        st.score_tilt(at, stacked),
    ]
    table = books[0]
    for book in books[1:]:
        table = table.unionByName(book)
    table = materialize(table)
    ruled = table.where(F.col("strategy").isin("equal_weight", "composite", "stacked", "tilt"))
    # The risk of all books in one pass over the windows.
    risk = materialize(sz.book_risk(ruled.unionByName(sz.held_names(unsized)), windows))
    governed = sz.vol_targeted(ruled, windows, risk=risk)
    limited = st.risk_managed(table.where(F.col("strategy") == "tilt"), sz.RiskLimits())
    table = materialize(
        table.unionByName(sz.sized(unsized, risk)).unionByName(governed).unionByName(limited)
    )
    paths = rows.select("k", "entity_id", "path")
    returns = materialize(rt.path_returns(table, paths, calendar, slots, costs))
    held = rt.buy_and_hold(pn.dense_panel(bars), slots.schedule.agg(F.min("as_of")).scalar())
    summary = rt.compare(returns, slots.n).unionByName(
        rt.summarize(held), allowMissingColumns=True
    )
    return summary, (rt.monte_carlo(returns, n_sims) if n_sims else None)


def _decision_rows(bars: DataFrame, calendar: DataFrame, slots: Slots) -> DataFrame:
    """All that books need of the panel, a row per decision time and name, from one pass over the bars.

    Price features as of the decision, the last returns (``n_obs``, ``xs``) and the returns of the bars up
    to the next decision (``path``).
    """
    times = calendar.select(F.col("event_time").alias("as_of"), F.col("t").cast("int").alias("t"), "n_dates")
    following = F.lead("t", 1).over(W.orderBy("k"))
    placed = materialize(
        slots.schedule.select("as_of", F.col("k").cast("int").alias("k")).join(times, "as_of")
        .withColumn("_end", F.coalesce(following, F.col("n_dates").cast("int") - 1)).drop("n_dates").coalesce(1)
    )
    positions = [r.t for r in placed.orderBy("k").collect()]  # a number per decision time
    series = pn.price_series(bars, calendar, positions, {"vol": (20, True), "lowvol_120": (120, False)})
    n_obs, xs = sz.trailing(90)
    rows = series.join(placed).select(
        "as_of", "k", "entity_id", "t", F.get("ff", F.col("t")).alias("ff"),
        pn.momentum_at(20).alias("mom_20"), pn.momentum_at(60).alias("mom"),
        pn.mean_reversion_at(5).alias("meanrev"), F.get("vol", F.col("k")).alias("vol"),
        pn.momentum_at(252, 21).alias("mom_252_skip21"),
        (-F.get("lowvol_120", F.col("k"))).alias("lowvol_120"), n_obs.alias("n_obs"), xs.alias("xs"),
        F.slice("ret", F.col("t") + 2, F.col("_end") - F.col("t")).alias("path"),
    )
    return materialize(rows)


def signal_report(
    bars: DataFrame, names: Sequence[str], extra: DataFrame | None = None, *, horizon: int = 5,
    every: int = 5, warmup: int = 60, max_dates: int | None = 120,
) -> DataFrame:
    """Measured IC of each signal with family-corrected verdicts."""
    bars = materialize(bars)
    price = [n for n in names if ft.is_price_feature(n)]
    panel = pn.with_forward_returns(ft.price_features(pn.dense_panel(bars), price), horizon)
    schedule = sample_dates(bars.select("event_time"), warmup, every, max_dates)
    matrix = st.at_decisions(panel, schedule)
    if extra is not None:
        matrix = matrix.join(extra, ["as_of", "entity_id"], "left")
    return si.correct_family(si.summarize_ics(si.date_ics(matrix, names)))


def daily_scoring(
    matrix: DataFrame, names: Sequence[str], at: DataFrame, model: str = "composite",
    quantile: float = 0.3, cap: int | None = 20, limits: sz.RiskLimits = sz.RiskLimits(),
    reserved: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(prediction log, target weights) of the plain selection path at every decision time."""
    from pitline.functions.crosssection import top_fraction

    scores = materialize(sc.composite(matrix, names))
    log = gr.predictions(scores, matrix, names, model)
    tradable = st.tradable(at).select("as_of", "entity_id").join(scores, ["as_of", "entity_id"])
    best = top_fraction(tradable, ["as_of"], "score", "entity_id", quantile, cap)
    if reserved is not None:
        best = best.join(reserved.select("entity_id"), "entity_id", "left_anti")
    picked = sz.selection_weights(best.withColumn("strategy", F.lit(model)), "equal")
    return log, sz.apply_risk_limits(picked, limits)


def event_gate(
    anchors: DataFrame, bars: DataFrame, n_permutations: int = 100, alpha: float = 0.05,
    post: int = 5,
) -> DataFrame:
    """Event types worth trading: those whose drift beats random re-anchoring."""
    bars = materialize(bars)
    dates = Slots(make_schedule(bars.select("event_time")))
    _, nulls = sd.run_study(anchors, pn.dense_panel(bars), dates, n_permutations, post=post)
    return sd.gate(nulls, alpha)


def screen_universe(bars: DataFrame, filers: DataFrame, **limits) -> DataFrame:
    """Liquid symbols that also file."""
    return un.liquidity_screen(un.filers_only(bars, filers), **limits)
