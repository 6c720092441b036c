"""Strategies as weight tables ``(strategy, as_of, entity_id, weight)`` for every decision time.

A strategy is a function of panel rows at the decision times (``at``: as_of, entity_id, t, ff and
feature columns) and, for some, a score table ``(as_of, entity_id, score)``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.crosssection import ordered_rank, top_fraction, top_k, zscore
from pitline.operators.scoring import tilt_weights
from pitline.operators.sizing import RiskLimits, apply_risk_limits, selection_weights, size_book
from pitline.session import materialize


def at_decisions(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """Panel rows at the decision times (which are panel dates), as ``as_of``."""
    times = schedule.select(F.col("as_of").alias("event_time"))
    return panel.join(times, "event_time").withColumnRenamed("event_time", "as_of")


def schedule_positions(panel: DataFrame, schedule: DataFrame) -> DataFrame:
    """``(as_of, t)`` of each decision time."""
    stamps = panel.select("event_time", "t").distinct()
    return schedule.select("as_of").join(
        stamps.withColumnRenamed("event_time", "as_of"), "as_of"
    )


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("strategy", F.lit(name))


def _equal(selected: DataFrame) -> DataFrame:
    return selection_weights(selected, "equal")


def tradable(at: DataFrame) -> DataFrame:
    """Names with any price by the decision time."""
    return at.where(F.col("ff").isNotNull())


def equal_weight(at: DataFrame, name: str = "equal_weight") -> DataFrame:
    return _equal(_named(tradable(at), name))


def momentum(
    at: DataFrame, lookback: int = 20, fraction: float = 0.5, name: str = "momentum"
) -> DataFrame:
    """Best ``fraction`` by the feature ``mom_<lookback>``, equal weight; 1/n during warm-up."""
    warm = tradable(at).where(F.col("t") + 1 <= lookback)
    ranked = top_fraction(
        at.where(F.col("t") + 1 > lookback), ["as_of"], f"mom_{lookback}", "entity_id", fraction
    )
    cols = ["strategy", "as_of", "entity_id"]
    return _equal(_named(ranked, name).select(*cols).unionByName(_named(warm, name).select(*cols)))


def price_composite(
    at: DataFrame,
    scores: DataFrame | None = None,
    max_positions: int = 20,
    quantile: float = 0.3,
    name: str = "composite",
) -> DataFrame:
    """Mean z-score of ``mom``, ``meanrev`` and sample ``vol``; top names, inverse-vol weights.

    ``scores`` joins as an equal fourth component. Rows without enough history (``mom`` over 60
    bars) take equal weights.
    """
    warm = _equal(_named(tradable(at).where(F.col("t") + 1 <= 61), name))
    full = at.where(
        (F.col("t") + 1 > 61)
        & F.col("mom").isNotNull()
        & F.col("meanrev").isNotNull()
        & F.col("vol").isNotNull()
    ).select("as_of", "entity_id", "mom", "meanrev", "vol")
    parts = ["mom", "meanrev", "vol"]
    if scores is not None:
        full = full.join(scores, ["as_of", "entity_id"], "left").withColumn(
            "score", F.coalesce("score", F.lit(0.0))
        )
        parts = [*parts, "score"]
    z = zscore(full, ["as_of"], parts, "_z")
    # A flat component contributes zeros.
    total = sum([F.coalesce(F.col(f"{p}_z"), F.lit(0.0)) for p in parts[1:]],
                F.coalesce(F.col(f"{parts[0]}_z"), F.lit(0.0)))
    ranked = z.withColumn("_score", total / len(parts))
    best = top_fraction(ranked, ["as_of"], "_score", "entity_id", quantile, max_positions)
    return selection_weights(_named(best, name), "inverse_vol").unionByName(warm)


def long_short(
    at: DataFrame, scores: DataFrame, per_side: int = 10, gross: float = 1.0,
    name: str = "ls_insider",
) -> DataFrame:
    """Long the highest and short the lowest scores, ``gross / 2`` a side."""
    active = tradable(at).select("as_of", "entity_id").join(
        scores.where(F.col("score").isNotNull() & (F.col("score") != 0)), ["as_of", "entity_id"]
    )
    sizes = active.groupBy("as_of").agg(F.count(F.lit(1)).alias("_n"))
    k = F.least(F.lit(per_side), F.floor(F.col("_n") / 2))
    # At most ``per_side`` names from either end: Spark prunes both before the shuffle.
    low = top_k(active, ["as_of"], per_side, F.col("score"), F.col("entity_id"))
    high = top_k(active, ["as_of"], per_side, F.col("score").desc(), F.col("entity_id").desc())
    legs = low.withColumn("_side", F.lit(-1.0)).unionByName(high.withColumn("_side", F.lit(1.0)))
    kept = legs.join(sizes, "as_of").withColumn("_k", k).where(F.col("rank") <= F.col("_k"))
    return _named(kept, name).select(
        "strategy", "as_of", "entity_id",
        (F.col("_side") * gross / (2.0 * F.col("_k"))).alias("weight"),
    )


def long_buyers(
    at: DataFrame, scores: DataFrame, max_positions: int = 30, name: str = "insider_long"
) -> DataFrame:
    """Equal-weighted book of the names with the highest positive score."""
    return top_scores(at, scores.where(F.col("score") > 0), max_positions, name)


def top_scores(
    at: DataFrame, scores: DataFrame, max_positions: int = 30, name: str = "stacked"
) -> DataFrame:
    """Equal-weighted book of the highest scores among tradable names."""
    known = tradable(at).select("as_of", "entity_id").join(
        scores.where(F.col("score").isNotNull()), ["as_of", "entity_id"]
    )
    best = top_k(known, ["as_of"], max_positions, F.col("score").desc(), F.col("entity_id"))
    return _equal(_named(best, name))


def score_tilt(
    at: DataFrame, scores: DataFrame | None, strength: float = 1.0, name: str = "tilt"
) -> DataFrame:
    """Every tradable name, leaning exponentially toward high scores."""
    return _named(tilt_weights(with_scores(at, scores), strength), name).select(
        "strategy", "as_of", "entity_id", "weight"
    )


def sized_book(
    at: DataFrame,
    windows: DataFrame,
    scores: DataFrame | None = None,
    target_vol: float = 0.10,
    limits: RiskLimits = RiskLimits(),
    strength: float = 0.0,
    name: str = "sized",
) -> DataFrame:
    """The tradable universe through ``size_book``."""
    return size_book(
        with_scores(at, scores), windows, target_vol=target_vol, limits=limits,
        tilt_strength=strength, strategy=name,
    )


def with_scores(at: DataFrame, scores: DataFrame | None) -> DataFrame:
    """The tradable names and their ``score``, null where there is none."""
    names = tradable(at).select("as_of", "entity_id")
    if scores is None:
        return names.withColumn("score", F.lit(None).cast("double"))
    return names.join(scores, ["as_of", "entity_id"], "left")


def risk_managed(
    weights: DataFrame, limits: RiskLimits, sectors: DataFrame | None = None,
    suffix: str = "+limits",
) -> DataFrame:
    """Any book passed through the risk limits."""
    return apply_risk_limits(weights, limits, sectors).withColumn(
        "strategy", F.concat("strategy", F.lit(suffix))
    )


def top_quantile(
    probabilities: DataFrame, quantile: float = 0.3, name: str = "forecast"
) -> DataFrame:
    """Equal-weighted book of the best ``quantile`` by predicted probability."""
    best = top_fraction(probabilities, ["as_of"], "probability", "entity_id", quantile)
    return _equal(_named(best, name))


def hysteresis_step(
    ranked: DataFrame, held: DataFrame, enter_k: int, exit_k: int, cap: int | None = None
) -> DataFrame:
    """One selection step: held names inside the exit band first, then entrants, at most ``cap``.

    ``ranked`` is ``(as_of, entity_id, score)``, ``held`` is ``(entity_id)``.
    """
    order = ordered_rank(ranked, ["as_of"], "score", "entity_id")
    flagged = order.join(
        held.select("entity_id").distinct().withColumn("_held", F.lit(True)), "entity_id", "left"
    ).withColumn("held", F.coalesce("_held", F.lit(False)))
    kept = flagged.where(
        (F.col("held") & (F.col("rank") <= exit_k)) | (~F.col("held") & (F.col("rank") <= enter_k))
    )
    if cap is None:
        return kept.select("as_of", "entity_id", "rank", "held")
    best = top_k(kept, ["as_of"], cap, F.col("held").desc(), F.col("rank"), out="_pick")
    return best.select("as_of", "entity_id", "rank", "held")


#: Decision times of a segment that is walked on its own.
SEGMENT = 64


def hysteresis_path(
    scores: DataFrame, fraction: float = 0.3, exit_multiple: float = 1.5, cap: int | None = 20,
    by: str = "strategy", segment: int = SEGMENT,
) -> DataFrame:
    """Selections over a whole history, where each step holds what the last one picked.

    Only rows inside the wider exit band can ever be held, so the ranks are cut to that band first.
    Without a cap a name is held if it came above the entry rank since it last entered the band: a window
    per name. With a cap, which couples the names, segments of decision times are walked apart
    from the state the uncapped path suggests; segments whose start differs from the end of the one
    before are walked again until none does. That is exact, since the first segment starts from
    nothing and each round settles one more at least, and mostly ends after a few rounds. A task
    holds the band of one segment.
    """
    inside = materialize(_bands(scores, fraction, exit_multiple, cap, by))
    free = _uncapped(inside, by)
    out = [by, "as_of", "entity_id", "rank"]
    if cap is None:
        return free.select(*out)
    seg = F.floor(F.col("k") / segment).cast("long")
    rows = materialize(inside.withColumn("seg", seg))
    guess = top_k(free, [by, "k"], cap, F.col("rank"), out="_pick")
    starts = _starts(guess, by, segment)
    solved = materialize(_walk(rows, starts, cap, by))
    while True:
        now = _starts(solved, by, segment)
        was = starts.withColumnRenamed("start", "_was")
        moved = materialize(
            now.join(was, [by, "seg"], "full").where(~F.col("start").eqNullSafe(F.col("_was")))
            .select(by, "seg", "start")
        )
        if not moved.limit(1).count():
            return solved.select(*out)
        key = moved.select(by, "seg")
        redone = _walk(rows.join(key, [by, "seg"], "left_semi"), moved, cap, by)
        solved = materialize(solved.join(key, [by, "seg"], "left_anti").unionByName(redone))
        starts = materialize(now)


def _bands(scores: DataFrame, fraction, exit_multiple, cap, by: str) -> DataFrame:
    """(by, as_of, k, entity_id, rank, enter_k) inside the exit band; k numbers the decision times."""
    ranked = ordered_rank(scores, [by, "as_of"], "score", "entity_id")
    base = F.greatest(F.lit(1), F.floor(F.col("rank_of") * F.lit(fraction)))
    enter = F.least(base, F.lit(cap)) if cap is not None else base
    banded = ranked.withColumn("enter_k", enter.cast("int")).withColumn(
        "exit_k",
        F.least(
            F.col("rank_of"),
            F.greatest(F.col("enter_k"), F.bround(F.col("enter_k") * exit_multiple)),
        ).cast("int"),
    )
    inside = materialize(banded.where(F.col("rank") <= F.col("exit_k")))
    times = inside.select(by, "as_of").distinct().withColumn(
        "k", F.row_number().over(W.partitionBy(by).orderBy("as_of")) - 1
    )
    return inside.join(times, [by, "as_of"]).select(
        by, "as_of", F.col("k").cast("long").alias("k"), "entity_id", F.col("rank").cast("int").alias("rank"), "enter_k"
    )


def _uncapped(inside: DataFrame, by: str) -> DataFrame:
    name = W.partitionBy(by, "entity_id").orderBy("k")
    run = W.partitionBy(by, "entity_id", "_run").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    entered = F.max((F.col("rank") <= F.col("enter_k")).cast("int")).over(run)
    runs = inside.withColumn("_run", F.col("k") - F.row_number().over(name))
    return runs.withColumn("_in", entered).where("_in = 1").drop("_run", "_in")


def _starts(picks: DataFrame, by: str, segment: int) -> DataFrame:
    """(by, seg, start): what the segment before ends with, at most ``cap`` names."""
    last = picks.where(F.col("k") % segment == segment - 1)
    return last.groupBy(by, (F.floor(F.col("k") / segment) + 1).cast("long").alias("seg")).agg(
        F.array_sort(F.collect_list("entity_id")).alias("start")
    )


def _walk(rows: DataFrame, starts: DataFrame, cap: int, by: str) -> DataFrame:
    """Picks of each segment from its start."""

    def segment(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "rank"])
        start = pdf["start"].iloc[0]
        held = set() if start is None else set(start)
        picked = []
        for _, day in pdf.groupby("k", sort=True):
            stay = day["entity_id"].isin(held)
            chosen = [*day.index[stay], *day.index[~stay & (day["rank"] <= day["enter_k"])]][:cap]
            held = set(day.loc[chosen, "entity_id"])
            picked.append(day.loc[chosen])
        return pd.concat(picked)[[by, "as_of", "k", "seg", "entity_id", "rank"]]

    return rows.join(starts, [by, "seg"], "left").groupBy(by, "seg").applyInPandas(
        segment, f"{by} string, as_of timestamp, k long, seg long, entity_id string, rank int"
    )
