"""Prediction logs: matured outcomes, grades, the trade journal, attribution, replayed learning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.crosssection import average_rank
from pitline.operators.returns import brier
from pitline.operators.scoring import correlation


def predictions(
    scores: DataFrame, matrix: DataFrame, names: Sequence[str], model: str, horizon: int = 5
) -> DataFrame:
    """Log rows of one scorer: rank percentile as probability plus the known features as a map."""
    ranked = average_rank(
        scores.where(F.col("score").isNotNull()), ["as_of"], "score", "probability", pct=True
    )
    known = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names])
        ),
        lambda _, v: v.isNotNull(),
    )
    return ranked.join(
        matrix.select("as_of", "entity_id", known.alias("features")), ["as_of", "entity_id"]
    ).select(
        "as_of", "entity_id", "probability", F.lit(horizon).alias("horizon_days"),
        F.lit(model).alias("model_version"), "features",
    )


def matured(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions whose full horizon has elapsed, with the realised return and the label.

    ``outcomes`` is ``(as_of, entity_id, fwd)`` with null where the horizon has not elapsed.
    """
    known = outcomes.where(F.col("fwd").isNotNull()).select("as_of", "entity_id", "fwd")
    return log.join(known, ["as_of", "entity_id"]).withColumnRenamed(
        "fwd", "realized_return"
    ).withColumn("outcome", (F.col("realized_return") > 0).cast("double"))


def hit() -> Column:
    """Share of predictions on the right side of one half."""
    return F.avg(
        ((F.col("probability") > 0.5).cast("double") == F.col("outcome")).cast("double")
    )


def score(graded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, Brier score and hit-rate of matured predictions."""
    out = graded.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), brier().alias("brier"), hit().alias("hit_rate")
    )
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("brier", "hit_rate")})


def score_against(log: DataFrame, realised: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Score predictions against a given outcome table ``(entity_id, realized_return)``."""
    joined = log.join(realised.where(F.col("realized_return").isNotNull()), "entity_id")
    label = (F.col("realized_return") > threshold).cast("double")
    return score(joined.withColumn("outcome", label))


def pooled_ic(graded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of each logged feature with the outcome over all graded rows.

    Constant features give no row.
    """
    long = graded.select(*by, "realized_return", F.explode("features").alias("signal", "x"))
    stats = long.groupBy(*by, "signal").agg(
        correlation("x", "realized_return").alias("ic"), F.stddev_samp("x").alias("_sd")
    )
    return stats.where((F.col("_sd") > 0) & F.col("ic").isNotNull()).drop("_sd")


def prune(ics: DataFrame, min_abs_ic: float = 0.02) -> DataFrame:
    """Flag each signal as kept or pruned by its absolute IC."""
    return ics.withColumn("kept", F.abs("ic") >= min_abs_ic)


def drift(live: DataFrame, value: str, baseline: float, tolerance: float = 0.10) -> DataFrame:
    """Flag a live metric that left the tolerance band around its baseline."""
    return live.withColumns(
        {
            "gap": F.col(value) - F.lit(baseline),
            "drifting": F.abs(F.col(value) - F.lit(baseline)) > tolerance,
        }
    )


def journal(graded: DataFrame, regimes: DataFrame) -> DataFrame:
    """Matured decisions with the macro regime at their time."""
    labels = regimes.select("as_of", F.col("label").alias("regime"))
    joined = graded.join(labels, "as_of", "left")
    return joined.select(
        "entity_id", "as_of", "probability", "realized_return",
        (F.col("realized_return") > 0).alias("won"),
        F.coalesce("regime", F.lit("unknown")).alias("regime"), "features",
    )


def attribution(entries: DataFrame) -> DataFrame:
    """Count, hit-rate and mean return overall (regime null) and per regime, in one pass."""
    return entries.rollup("regime").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("won").cast("double")).alias("hit_rate"),
        F.avg("realized_return").alias("mean_return"),
    )


def attribution_ic(entries: DataFrame) -> DataFrame:
    """Feature ICs overall (regime ``all``) and per regime."""
    both = entries.withColumn("regime", F.explode(F.array(F.col("regime"), F.lit("all"))))
    return pooled_ic(both, ["regime"])


def best_and_worst(entries: DataFrame, n: int = 5) -> DataFrame:
    """The n best and n worst decisions by realised return (global; pruned per task first)."""
    best = entries.orderBy(F.col("realized_return").desc(), "entity_id", "as_of").limit(n)
    worst = entries.orderBy("realized_return", "entity_id", "as_of").limit(n)
    return best.withColumn("side", F.lit("best")).unionByName(
        worst.withColumn("side", F.lit("worst"))
    )


def expanding_ic(graded: DataFrame, matured_at: str, rebalances: DataFrame) -> DataFrame:
    """IC of each signal as measured at every rebalance, from all predictions matured by then.

    ``graded`` carries the slot ``matured_at`` at which each prediction can first be graded.
    Correlations come from running sums of moments, so nothing is graded twice. The moments are
    taken around a common origin per signal to keep them well scaled.
    Output: ``(k, signal, ic, n)``.
    """
    long = graded.select(
        F.col(matured_at).alias("k"),
        F.col("realized_return").alias("y"),
        F.explode("features").alias("signal", "x"),
    )
    centre = long.groupBy("signal").agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    x, y = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    moments = long.join(centre, "signal").groupBy("signal", "k").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"),
        F.sum(y * y).alias("syy"),
        F.sum(x * y).alias("sxy"),
    )
    signals = long.select("signal").distinct().agg(F.collect_set("signal")).scalar()
    grid = rebalances.select(F.col("k")).withColumn("signal", F.explode(signals))
    upto = W.partitionBy("signal").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    run = grid.join(moments, ["signal", "k"], "left").select(
        "signal", "k", *[F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c) for c in sums]
    )
    n = F.col("n")
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    ic = F.when((n > 1) & (vx > 1e-18) & (vy > 1e-18), cov / F.sqrt(vx * vy))
    return run.withColumn("ic", ic).select("k", "signal", "ic", "n")


def panel_view(views: DataFrame, risk_weight: float = 0.5) -> DataFrame:
    """Combine role views ``(as_of, entity_id, role, score, confidence)`` into one signal a name.

    Direction is the confidence-weighted mean of the non-risk roles; conviction is their mean
    confidence, shrunk by disagreement and damped by the risk role.
    """
    key = ["as_of", "entity_id"]
    w = min(1.0, max(0.0, float(risk_weight)))
    directional = (F.col("role") != "risk") & (F.col("confidence") > 0)
    agg = views.groupBy(*key).agg(
        F.sum(F.when(directional, F.col("confidence"))).alias("_w"),
        F.count(F.when(directional, 1)).alias("_n"),
        F.sum(F.when(directional, F.col("score") * F.col("confidence"))).alias("_ws"),
        F.min_by(
            F.struct("score", "confidence"), F.when(F.col("role") == "risk", 0)
        ).alias("_risk"),
    )
    joined = views.where(directional).join(
        agg.select(*key, (F.col("_ws") / F.col("_w")).alias("_mean")), key
    )
    spread = joined.groupBy(*key).agg(
        F.sum(F.abs(F.col("score") - F.col("_mean")) * F.col("confidence")).alias("_dev")
    )
    rows = agg.join(spread, key, "left")
    mean_conf = F.col("_w") / F.col("_n")
    agreement = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("_dev") / F.col("_w") / 2.0)
    )
    danger = 1.0 - w * (1.0 - F.col("_risk.score")) / 2.0
    damp = F.when(
        F.col("_risk.confidence") > 0, 1.0 - F.col("_risk.confidence") * (1.0 - danger)
    ).otherwise(1.0)
    none = F.col("_n") == 0
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_ws") / F.col("_w")))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean_conf * agreement * damp))
    return rows.select(
        *key,
        F.when(none, 0.0).otherwise(bounded).alias("score"),
        F.when(none, 0.0).otherwise(conf).alias("confidence"),
        F.col("_n").alias("n_views"),
    )
