"""Measuring signals: rank IC per date, summaries, family corrections, the sealed holdout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.crosssection import average_rank
from pitline.functions.scalars import bonferroni_bar, ic_verdict, normal_two_sided_p
from pitline.functions.timeline import make_schedule
from pitline.operators.scoring import correlation
from pitline.session import materialize


def date_ics(matrix: DataFrame, names: Sequence[str], min_names: int = 5) -> DataFrame:
    """``(signal, as_of, ic, n_common)`` from a matrix with a matured forward return ``fwd``.

    Forward returns are ranked over all names that have one; a signal over the names that have
    both. Dates with too few names, or a flat signal, give no row.
    """
    common = materialize(matrix.where(F.col("fwd").isNotNull()))
    ranked = average_rank(common, ["as_of"], "fwd", "_rf")
    sizes = common.groupBy("as_of").agg(F.count(F.lit(1)).alias("n_common"))
    long = ranked.select("as_of", "entity_id", "_rf", *names).unpivot(
        ["as_of", "entity_id", "_rf"], list(names), "signal", "x"
    )
    long = materialize(long.where(F.col("x").isNotNull()))
    both = average_rank(long, ["as_of", "signal"], "x", "_rx")
    per = both.groupBy("signal", "as_of").agg(
        F.count(F.lit(1)).alias("_n"),
        F.stddev_samp("x").alias("_sd"),
        correlation("_rx", "_rf").alias("ic"),
    )
    kept = per.join(sizes, "as_of").where(
        (F.col("n_common") >= min_names)
        & (F.col("_n") >= min_names)
        & (F.col("_sd") > 0)
        & F.col("ic").isNotNull()
    )
    return kept.select("signal", "as_of", "ic", "n_common")


def summarize_ics(ics: DataFrame) -> DataFrame:
    """Mean, spread, t-statistic and hit-rate of the per-date ICs of each signal."""
    inf = F.lit(float("inf"))
    n, mean = F.col("n_dates"), F.col("mean_ic")
    stats = ics.groupBy("signal").agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.sum("n_common").alias("n_obs"),
        F.avg("ic").alias("mean_ic"),
        F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("ic_std"),
        F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"),
    )
    sd = F.col("ic_std")
    t = (
        F.when((n > 1) & (sd > 0), mean / (sd / F.sqrt(n)))
        .when((n > 1) & (mean > 0), inf)
        .when((n > 1) & (mean < 0), -inf)
        .otherwise(0.0)
    )
    return stats.withColumn("t_stat", t)


def correct_family(summary: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg verdicts over all signals tested together.

    The table holds one row per signal, so the ranks over it are small.
    """
    everything = W.partitionBy(F.lit(1))
    m = F.count(F.lit(1)).over(everything)
    rows = summary.withColumn("p_value", normal_two_sided_p("t_stat")).withColumn("_m", m)
    rows = rows.withColumn("_bar", bonferroni_bar(F.col("_m"), F.lit(alpha)))
    order = everything.orderBy("p_value", "signal")
    rows = rows.withColumn("_rank", F.row_number().over(order))
    passing = F.when(F.col("p_value") <= F.col("_rank") / F.col("_m") * alpha, F.col("_rank"))
    rows = rows.withColumn("_cut", F.coalesce(F.max(passing).over(everything), F.lit(0)))
    rows = rows.withColumns(
        {
            "bonferroni": F.abs("t_stat") >= F.col("_bar"),
            "fdr": F.col("_rank") <= F.col("_cut"),
            "bonferroni_t": F.col("_bar"),
        }
    )
    rows = rows.withColumn("verdict", ic_verdict("t_stat", F.col("bonferroni"), F.col("fdr")))
    return rows.drop("_m", "_bar", "_rank", "_cut")


def time_split(schedule: DataFrame, train_fraction: float = 0.6) -> DataFrame:
    """Flag the first fraction of the decision times as training."""
    ordered = make_schedule(schedule, "as_of")
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    return ordered.withColumn("is_train", F.col("k") < F.floor(n * F.lit(train_fraction)))


def holdout_start(calendar: DataFrame, fraction: float = 0.2) -> DataFrame:
    """First date of the sealed last ``fraction`` of the price history (null under two dates)."""
    ordered = make_schedule(calendar)
    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    marked = ordered.withColumn("_n", n)
    cut = F.least(F.floor(F.col("_n") * F.lit(1.0 - fraction)), F.col("_n") - 1)
    return marked.where((F.col("_n") >= 2) & (F.col("k") == cut)).select(
        F.col("as_of").alias("holdout_start")
    )


def first_looks(ledger: DataFrame) -> DataFrame:
    """The one look per signal that counts: the earliest recorded."""
    w = W.partitionBy("signal").orderBy("decided_at")
    ranked = ledger.withColumn("_rn", F.row_number().over(w))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def confirm(ledger: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single-look confirmation: ``(looks that count with is_repeat, rows to append)``.

    A signal with an earlier look by the candidate's time gets that look back; nothing is written.
    """
    known = ledger.join(
        candidates.select("signal", F.col("decided_at").alias("_now")), "signal"
    ).where(F.col("decided_at") <= F.col("_now")).drop("_now")
    earlier = first_looks(known.select(*candidates.columns)).withColumn("is_repeat", F.lit(True))
    fresh = candidates.join(earlier.select("signal"), "signal", "left_anti")
    return earlier.unionByName(fresh.withColumn("is_repeat", F.lit(False))), fresh
