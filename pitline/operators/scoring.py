"""Signal weights and composite scores, for all decision times at once.

Long form: a score table is ``(as_of, entity_id, score)``, signal weights are
``([as_of,] signal, weight)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.crosssection import average_rank, zscore
from pitline.functions.timeline import Slots

AT = ["as_of"]


def spearman_ic(pairs: DataFrame, by: Sequence[str], x: str = "x", y: str = "fwd") -> DataFrame:
    """Rank correlation per group over complete pairs; null with fewer than three."""
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, by, x, "_rx"), by, y, "_ry")
    n = F.count(F.lit(1))
    return ranked.groupBy(*by).agg(
        n.alias("n_names"), F.when(n >= 3, correlation("_rx", "_ry")).alias("ic")
    )


def correlation(x: str, y: str) -> Column:
    """Pearson correlation over complete pairs, null when a side is flat.

    Built from covariance and deviations: the built-in one divides by zero on a flat side.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def inverse_variance_weights(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """Weights proportional to 1/variance of each signal; flat signals get 0, all flat gets 1/n."""
    var = matrix.groupBy(*AT).agg(*[F.var_pop(n).alias(n) for n in names])
    inv = [F.when(F.col(n) > 0, 1.0 / F.col(n)).otherwise(0.0) for n in names]
    total = sum(inv[1:], inv[0])
    return var.select(
        "as_of",
        *[
            F.when(total > 0, i / total).otherwise(1.0 / len(names)).alias(n)
            for n, i in zip(names, inv, strict=True)
        ],
    ).unpivot(AT, list(names), "signal", "weight")


def ic_weights(ics: DataFrame, by: Sequence[str] = (), cap: float = 0.5, min_abs: float = 0.0):
    """Weights ic / sum of absolute ic, clipped; weak signals dropped, all weak gives 1/n.

    ``ics`` is ``(*by, signal, ic)`` with every signal present (a missing ic counts as 0).
    """
    ic = F.coalesce(F.col("ic"), F.lit(0.0))
    kept = ics.withColumn("_ic", F.when(F.abs(ic) >= min_abs, ic).otherwise(0.0))
    totals = kept.groupBy(*by).agg(
        F.sum(F.abs("_ic")).alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    if by:
        joined = kept.join(totals, list(by))
    else:  # the totals are one row
        one = totals.select(F.struct("_sum", "_n")).scalar()
        joined = kept.withColumn("_t", one).select("*", "_t.*")
    share = F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("_ic") / F.col("_sum")))
    weight = F.when(F.col("_sum") == 0, 1.0 / F.col("_n")).otherwise(share)
    return joined.select(*by, "signal", weight.alias("weight"))


def orthogonality(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """``1 / (1 + sum of |corr| with every other signal)`` per (as_of, signal).

    The pairs are of signals (a handful of columns), all correlated in one aggregation.
    """
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    corr = matrix.groupBy(*AT).agg(
        *[F.coalesce(F.abs(correlation(a, b)), F.lit(0.0)).alias(f"{a}~{b}") for a, b in pairs]
    )
    out = []
    for n in names:
        mine = [F.col(f"`{a}~{b}`") for a, b in pairs if n in (a, b)]
        total = sum(mine[1:], mine[0]) if mine else F.lit(0.0)
        out.append((1.0 / (1.0 + total)).alias(n))
    return corr.select("as_of", *out).unpivot(AT, list(names), "signal", "quality")


def composite(
    matrix: DataFrame,
    names: Sequence[str],
    weights: DataFrame | None = None,
    quality: DataFrame | None = None,
    decay: dict[str, float] | None = None,
) -> DataFrame:
    """Sum of weight x z-score per entity, weights rescaled to unit absolute sum.

    Null z-scores count as 0. ``weights`` is ``([as_of,] signal, weight)``, equal when missing;
    ``quality`` is ``(as_of, signal, quality)``; ``decay`` maps a signal to a factor.
    """
    z = zscore(matrix.select(*AT, "entity_id", *names), AT, names)
    dates = matrix.select("as_of").distinct()
    per = dates.withColumn("signal", F.explode(F.array(*[F.lit(n) for n in names])))
    if weights is None:
        per = per.withColumn("weight", F.lit(1.0 / len(names)))
    else:
        per = per.join(weights, [c for c in ("as_of", "signal") if c in weights.columns], "left")
        per = per.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    if quality is not None:
        per = per.join(quality, ["as_of", "signal"], "left").withColumn(
            "weight", F.col("weight") * F.coalesce("quality", F.lit(1.0))
        )
    if decay:
        factor = F.coalesce(
            *[F.when(F.col("signal") == n, F.lit(float(d))) for n, d in decay.items()], F.lit(1.0)
        )
        per = per.withColumn("weight", F.col("weight") * factor)
    # One row of weights per decision time, so the rows of the matrix are joined once.
    wide = per.groupBy("as_of").agg(
        F.sum(F.abs("weight")).alias("_scale"),
        *[F.max(F.when(F.col("signal") == n, F.col("weight"))).alias(f"_w_{n}") for n in names],
    )
    terms = [F.coalesce(F.col(n) * F.col(f"_w_{n}"), F.lit(0.0)) for n in names]
    total = sum(terms[1:], terms[0])
    score = F.when(F.col("_scale") > 0, total / F.col("_scale")).otherwise(total)
    return z.join(wide, AT).select("as_of", "entity_id", score.alias("score"))


def mean_composite(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """Plain mean of the z-scores that exist; null when none does."""
    z = zscore(matrix.select(*AT, "entity_id", *names), AT, names)
    known = [F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names]
    terms = [F.coalesce(F.col(n), F.lit(0.0)) for n in names]
    n = sum(known[1:], known[0])
    score = F.when(n > 0, sum(terms[1:], terms[0]) / n)
    return z.select("as_of", "entity_id", score.alias("score"))


def bootstrap_ics(
    live: DataFrame, offline: DataFrame, min_abs: float, min_dates: int = 8, min_t: float = 2.0
) -> DataFrame:
    """``(signal, ic)`` from live grades if there are any, else the significant offline ones."""
    cold = offline.where(
        (F.col("n_dates") >= min_dates)
        & (F.abs("t_stat") >= min_t)
        & (F.abs("mean_ic") >= min_abs)
    ).select("signal", F.col("mean_ic").alias("ic"))
    any_live = live.agg(F.count(F.lit(1)) > 0).scalar()
    return live.select("signal", "ic").unionByName(cold.where(~any_live))


def tilt_weights(scores: DataFrame, strength: float) -> DataFrame:
    """Weights proportional to ``exp(strength * z)`` with z clipped to 3; 1/n without a tilt.

    A missing score counts as 0. Input ``(as_of, entity_id, score)`` lists the tradable names.
    """
    filled = scores.withColumn("score", F.coalesce("score", F.lit(0.0)))
    z = zscore(filled, AT, ["score"], "_z")
    k = max(float(strength), 0.0)
    raw = z.withColumn(
        "_raw", F.exp(F.lit(k) * F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("score_z"))))
    )
    total = raw.groupBy(*AT).agg(F.sum("_raw").alias("_total"))
    return raw.join(total, AT).select(
        "as_of", "entity_id", (F.col("_raw") / F.col("_total")).alias("weight")
    )


# --- a scorer that changes as evidence grows ------------------------------------------------------

# What a signal's measured IC amounts to.
COLD, MEASURED, PRUNED = "cold", "measured", "pruned"


def evidence(history: DataFrame, names: Sequence[str], rebalances: DataFrame, min_abs: float = 0.02) -> DataFrame:
    """``(k, signal, ic, state)`` for every rebalance ``k`` and signal.

    ``history`` is ``(k, signal, ic)`` as measured by then. A signal without an IC is cold, one below
    ``min_abs`` pruned.
    """
    every = rebalances.select("k").withColumn("signal", F.explode(F.array(*[F.lit(n) for n in names])))
    state = (
        F.when(F.col("ic").isNull() | F.isnan("ic"), COLD).when(F.abs("ic") >= min_abs, MEASURED)
        .otherwise(PRUNED)
    )
    return every.join(history.select("k", "signal", "ic"), ["k", "signal"], "left").withColumn("state", state)


def evidence_intervals(states: DataFrame) -> DataFrame:
    """``(signal, state, k_from, k_to)``: from which rebalance up to before which a state holds.

    The last interval of a signal has no end.
    """
    path = W.partitionBy("signal").orderBy("k")
    moved = ~F.col("state").eqNullSafe(F.lag("state").over(path))
    runs = states.withColumn("_run", F.sum(moved.cast("int")).over(path.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("signal", "_run").agg(F.first("state").alias("state"), F.min("k").alias("k_from"))
    following = F.lead("k_from").over(W.partitionBy("signal").orderBy("_run"))
    return spans.select("signal", "state", "k_from", following.alias("k_to"))


def evidence_at(intervals: DataFrame, slots: Slots, times: DataFrame, at: str) -> DataFrame:
    """Rows of ``times`` with each signal's state at time ``at``, as of the last rebalance by then.

    A time maps to its rebalance by an equi-join, and a handful of intervals per signal meet it there.
    """
    placed = slots.assign(times, at, "k", after=True).withColumn("k", F.col("k") - 1)
    every = slots.schedule.select("k").join(
        intervals, (F.col("k_from") <= F.col("k")) & (F.col("k_to").isNull() | (F.col("k") < F.col("k_to")))
    ).select("k", "signal", "state")
    return placed.join(every, "k")


def scorer_weights(states: DataFrame, cap: float = 0.5) -> DataFrame:
    """``(k, signal, weight)`` of the scorer in force at each rebalance.

    Measured signals share the weight by their IC, pruned and cold ones have none; as long as none is
    measured all have the same.
    """
    usable = states.withColumn("ic", F.when(F.col("state") == MEASURED, F.col("ic")).otherwise(0.0))
    return ic_weights(usable.select("k", "signal", "ic"), ["k"], cap)
