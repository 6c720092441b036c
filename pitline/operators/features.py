"""Cross-sectional features for all decision times at once: ``(as_of, entity_id, value...)``.

Price features are window columns over one dense panel. Flow, news and fundamental features are
sums of facts that become visible at one slot of the schedule and expire at another.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.crosssection import zscore
from pitline.functions.timeline import Slots
from pitline.operators.bitemporal import versions, with_validity
from pitline.operators.panel import mean_reversion, momentum, rolling_vol
from pitline.session import materialize

# The feature sets by name.
DEFAULT_SET = [
    "mom_252_skip21", "mom_60", "vol_20", "insider_net_buys_90d_opp", "congress_lead_buys_120d",
]
CANDIDATE_SET = [
    *DEFAULT_SET,
    "insider_net_buys_90d", "lowvol_120", "earnings_yield", "earnings_surprise",
    "llm_news_sentiment_10d",
]
STACK_SET = [
    "insider_net_buys_90d_opp", "earnings_surprise", "earnings_yield", "mom_252_skip21",
    "lowvol_120",
]
NEWS_SET = ["news_attention_7", "news_tone_7"]
INTRADAY_SET = ["mom_30", "meanrev_5", "vol_30"]


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def price_feature(name: str) -> Column:
    """Window column of a price feature from its name, e.g. ``mom_252_skip21`` or ``lowvol_120``."""
    kind, *rest = name.split("_")
    if kind == "mom":
        skip = int(rest[1].removeprefix("skip")) if len(rest) > 1 else 0
        return momentum(int(rest[0]), skip)
    if kind == "meanrev":
        return mean_reversion(int(rest[0]))
    if kind == "vol":
        return rolling_vol(int(rest[0]))
    if kind == "lowvol":
        return -rolling_vol(int(rest[0]))
    raise ValueError(f"not a price feature: {name}")


def is_price_feature(name: str) -> bool:
    return name.split("_")[0] in ("mom", "meanrev", "vol", "lowvol")


def price_features(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """The panel with one column per price feature, from a single pass per entity."""
    return panel.withColumns({n: price_feature(n) for n in names})


def routine_spells(filings: DataFrame, min_years: int = 3) -> DataFrame:
    """Times during which an insider counts as routine: ``(insider_name, from, until)``.

    Routine means visible filings in the same calendar month of ``min_years`` distinct years. A
    filing counts from its knowledge time until a newer version replaces it. Insiders without a
    replaced filing (most) are routine for ever from the ``min_years``-th first filing of a month on; only
    the others' filings are followed through time.
    """
    visible = filings.where(F.coalesce(F.col("insider_name"), F.lit("")) != "")
    replaced = materialize(
        visible.where(F.col("known_until").isNotNull()).select("insider_name").distinct()
    )
    lasting = visible.join(replaced, "insider_name", "left_anti")
    # One shuffle and one sort serve the count of years in a month, the insider's first month and no more.
    years = W.partitionBy("insider_name", "month").orderBy("year")
    counted = lasting.repartition("insider_name").select(
        "insider_name", F.col("knowledge_time").alias("from"),
        F.month("knowledge_time").alias("month"), F.year("knowledge_time").alias("year"),
    ).withColumn("_n", F.dense_rank().over(years))
    steady = counted.groupBy("insider_name").agg(
        F.min(F.when(F.col("_n") == min_years, F.col("from"))).alias("from")
    ).where(F.col("from").isNotNull())
    steady = steady.withColumn("until", F.lit(None).cast("timestamp"))
    return steady.unionByName(
        _switched_spells(visible.join(replaced, "insider_name", "left_semi"), min_years)
    )


def _switched_spells(visible: DataFrame, min_years: int) -> DataFrame:
    """``routine_spells`` of filings that newer versions may replace."""
    marks = visible.select(
        "insider_name",
        F.month("knowledge_time").alias("month"),
        F.year("knowledge_time").alias("year"),
        F.explode(
            F.array(
                F.struct(F.col("knowledge_time").alias("at"), F.lit(1).alias("d")),
                F.struct(F.col("known_until").alias("at"), F.lit(-1).alias("d")),
            )
        ).alias("m"),
    ).where(F.col("m.at").isNotNull())
    year_key = ["insider_name", "month", "year"]
    present = _switches(
        marks.groupBy(*year_key, F.col("m.at").alias("at")).agg(F.sum("m.d").alias("d")),
        year_key,
        1,
    )
    month_key = ["insider_name", "month"]
    enough = _switches(
        present.groupBy(*month_key, "at").agg(F.sum("d").alias("d")), month_key, min_years
    )
    routine = _switches(
        enough.groupBy("insider_name", "at").agg(F.sum("d").alias("d")), ["insider_name"], 1
    )
    w = W.partitionBy("insider_name").orderBy("at")
    return (
        routine.withColumn("until", F.lead("at").over(w))
        .where(F.col("d") > 0)
        .select("insider_name", F.col("at").alias("from"), "until")
    )


def _switches(moves: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Times at which a running count reaches (+1) or leaves (-1) ``level``."""
    w = W.partitionBy(*keys).orderBy("at")
    moves = moves.where(F.col("d") != 0)
    on = F.when(F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)) >= level, 1).otherwise(0)
    counted = moves.withColumn("_on", on)
    change = F.col("_on") - F.coalesce(F.lag("_on").over(w), F.lit(0))
    return counted.withColumn("d", change).where(F.col("d") != 0).select(*keys, "at", "d")


def insider_net_buys(
    filings: DataFrame, slots: Slots, window_days: int = 90, opportunistic: bool = False
) -> DataFrame:
    """Purchases minus all other transactions known within the window; absent means 0."""
    facts = versions(filings)
    expiry = F.least(F.col("knowledge_time") + days(window_days), F.col("known_until"))
    name = f"insider_net_buys_{window_days}d" + ("_opp" if opportunistic else "")
    sign = F.when(F.coalesce(F.col("is_purchase"), F.lit(False)), 1).otherwise(-1)
    seen = facts.where(F.col("knowledge_time") < expiry)
    spans = slots.spans(seen.withColumn("_net", sign), "knowledge_time", expiry)
    sums = {name: F.col("_net")}
    if opportunistic:
        # Sums can be taken back: a filing counts at all of its slots, less those at which its insider is routine.
        spans = materialize(spans.select("entity_id", "insider_name", "k_from", "k_to", "_net"))
        spells = slots.spans(routine_spells(facts), "from", "until").select(
            "insider_name", F.col("k_from").alias("_from"), F.col("k_to").alias("_to")
        )
        first, last = F.greatest("k_from", "_from"), F.least("k_to", "_to")
        hidden = spans.join(spells, "insider_name").where(first < last).select(
            "entity_id", first.alias("k_from"), last.alias("k_to"), (-F.col("_net")).alias("_net"),
            F.lit(-1).alias("_n"),
        )
        counted = spans.select("entity_id", "k_from", "k_to", "_net", F.lit(1).alias("_n"))
        spans = counted.unionByName(hidden)
        sums = {"n_visible": F.col("_n"), **sums}
    return slots.with_as_of(slots.rolling_sums(spans, ["entity_id"], sums)).drop("n_visible")


def leadership_buys(trades: DataFrame, slots: Slots, window_days: int = 120) -> DataFrame:
    """Buys by high-signal office holders known within the window; absent means 0."""
    facts = versions(trades).where(
        F.col("high_signal_role") & (F.col("transaction_type") == "buy")
    )
    expiry = F.least(F.col("knowledge_time") + days(window_days), F.col("known_until"))
    spans = slots.spans(facts, "knowledge_time", expiry)
    summed = slots.rolling_sums(spans, ["entity_id"], {})
    return slots.with_as_of(summed).withColumnRenamed(
        "n_visible", f"congress_lead_buys_{window_days}d"
    )


def news_features(articles: DataFrame, slots: Slots, window_days: int = 7) -> DataFrame:
    """Attention ``log1p(articles)`` and mean tone of the window (inclusive old end)."""
    facts = with_validity(articles).withColumn(
        "_expires", F.col("event_time") + days(window_days)
    )
    # The window closes after its old end, a newer version replaces at its own time.
    facts = slots.assign(facts, "knowledge_time", "k_from")
    facts = slots.assign(facts, "_expires", "_k_window", after=True)
    facts = slots.assign(facts, "known_until", "_k_version")
    spans = facts.withColumn("k_to", F.least("_k_window", "_k_version")).where(
        F.col("k_from") < F.col("k_to")
    )
    sums = {
        "_tone": F.coalesce(F.col("tone"), F.lit(0.0)),
        "_n_tone": F.when(F.col("tone").isNotNull(), 1).otherwise(0),
    }
    out = slots.with_as_of(slots.rolling_sums(spans, ["entity_id"], sums))
    mean = F.when(F.col("_n_tone") > 0, F.col("_tone") / F.col("_n_tone")).otherwise(0.0)
    return out.select(
        "as_of",
        "entity_id",
        F.log1p("n_visible").alias(f"news_attention_{window_days}"),
        mean.alias(f"news_tone_{window_days}"),
    )


def text_sentiment(reads: DataFrame, slots: Slots, window_days: int = 10) -> DataFrame:
    """Score times confidence of the newest read inside the window; absent means 0."""
    scored = reads.withColumn(
        "_v",
        F.coalesce(F.col("score"), F.lit(0.0)) * F.coalesce(F.col("confidence"), F.lit(0.0)),
    )
    newest = slots.latest(
        scored,
        ["entity_id"],
        "knowledge_time",
        ["_v", "knowledge_time"],
        F.struct("knowledge_time", "event_time", "observation_id"),
    )
    out = slots.with_as_of(newest).where(
        F.col("knowledge_time") > F.col("as_of") - days(window_days)
    )
    return out.select("as_of", "entity_id", F.col("_v").alias(f"llm_news_sentiment_{window_days}d"))


def earnings_history(reports: DataFrame, slots: Slots) -> DataFrame:
    """Visible quarters per (k, entity) as an array sorted by quarter end.

    A filing history is short (quarters of one entity), so the array is bounded by time.
    """
    known = with_validity(reports.where(F.col("eps").isNotNull()))
    spans = slots.spans(known, "knowledge_time", "known_until")
    rows = spans.select(
        "entity_id",
        F.struct(
            "event_time", "eps", "knowledge_time", "k_from", "k_to"
        ).alias("q"),
    )
    per_entity = rows.groupBy("entity_id").agg(F.array_sort(F.collect_list("q")).alias("qs"))
    changes = per_entity.withColumn(
        "k0",
        F.explode(
            F.array_distinct(
                F.concat(F.transform("qs", lambda q: q["k_from"]),
                         F.transform("qs", lambda q: q["k_to"]))
            )
        ),
    ).where(F.col("k0") < slots.n)
    w = W.partitionBy("entity_id").orderBy("k0")
    return changes.select(
        "entity_id",
        "k0",
        F.coalesce(F.lead("k0").over(w), F.lit(slots.n)).alias("k1"),
        F.filter(
            "qs", lambda q: (q["k_from"] <= F.col("k0")) & (q["k_to"] > F.col("k0"))
        ).alias("quarters"),
    )


def earnings_features(
    reports: DataFrame,
    slots: Slots,
    prices_at: DataFrame | None = None,
    drift_days: int = 90,
    min_quarters: int = 8,
) -> DataFrame:
    """``earnings_yield`` (needs ``prices_at``: as_of, entity_id, price) and ``earnings_surprise``.

    Null means no opinion: fewer than four quarters, a stale report, or no spread to scale by.
    """
    history = earnings_history(reports, slots)
    eps = F.transform("quarters", lambda q: q["eps"])
    n = F.size("quarters")
    last4 = F.aggregate(
        F.slice(eps, -4, 4), F.lit(0.0), lambda a, x: a + x
    )
    sue = F.when(n >= max(min_quarters, 7), _surprise(eps, n))
    computed = history.select(
        "entity_id",
        F.explode(F.sequence(F.col("k0"), (F.col("k1") - 1).cast("int"))).alias("k"),
        F.when(n >= 4, last4).alias("eps_ttm"),
        sue.alias("_sue"),
        F.try_element_at("quarters", F.lit(-1))["knowledge_time"].alias("_filed"),
        n.alias("_n"),
    ).where(F.col("_n") > 0)
    out = slots.with_as_of(computed)
    fresh = F.col("_filed") > F.col("as_of") - days(drift_days)
    out = out.withColumn("earnings_surprise", F.when(fresh, F.col("_sue")))
    if prices_at is not None:
        out = out.join(prices_at, ["as_of", "entity_id"], "left").withColumn(
            "earnings_yield", F.when(F.col("price") > 0, F.col("eps_ttm") / F.col("price"))
        )
        return out.select("as_of", "entity_id", "earnings_yield", "earnings_surprise")
    return out.select("as_of", "entity_id", "eps_ttm", "earnings_surprise")


def _surprise(eps: Column, n: Column) -> Column:
    """Latest year-over-year change over the deviation of the earlier ones."""
    diffs = F.zip_with(
        F.slice(eps, 5, F.greatest(n - 4, F.lit(0))),
        F.slice(eps, 1, F.greatest(n - 4, F.lit(0))),
        lambda a, b: a - b,
    )
    m = n - 5
    prior = F.slice(diffs, 1, F.greatest(m, F.lit(0)))
    mean = F.aggregate(prior, F.lit(0.0), lambda a, x: a + x) / m
    squares = F.aggregate(prior, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    sd = F.sqrt(squares / (m - 1))
    return F.when((m >= 2) & (sd > 0), F.element_at(diffs, -1) / sd)


def macro_regime(series: DataFrame, slots: Slots) -> DataFrame:
    """Yield-curve slope and risk flag per decision time; no slope counts as risk-on."""
    known = series.where(F.col("value").isNotNull())
    newest = slots.latest(
        known,
        ["entity_id"],
        "knowledge_time",
        ["value"],
        F.struct("knowledge_time", "event_time", "source", "revision"),
    )
    rates = newest.groupBy("k").agg(
        F.max(F.when(F.col("entity_id") == "DGS10", F.col("value"))).alias("_long"),
        F.max(F.when(F.col("entity_id") == "DGS2", F.col("value"))).alias("_short"),
        F.count(F.lit(1)).alias("n_series"),
    )
    slope = F.col("_long") - F.col("_short")
    risk_on = slope.isNull() | (slope > 0)
    return slots.schedule.join(rates, "k", "left").select(
        "as_of",
        slope.alias("yield_curve_slope"),
        risk_on.alias("risk_on"),
        F.when(risk_on, "risk_on").otherwise("risk_off").alias("label"),
        F.coalesce("n_series", F.lit(0)).alias("n_series"),
    )


def feature_matrix(universe: DataFrame, parts: Sequence[DataFrame], zero: Sequence[str]) -> DataFrame:
    """Join feature tables onto ``universe`` (as_of, entity_id); ``zero`` columns fill with 0."""
    joined = reduce(lambda a, b: a.join(b, ["as_of", "entity_id"], "left"), parts, universe)
    present = [c for c in zero if c in joined.columns]
    return joined.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in present}
    )


def zscored(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every feature standardised within its decision time."""
    return zscore(matrix, ["as_of"], list(names))


def long_form(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(as_of, entity_id, signal, x)``, keeping null values."""
    return matrix.unpivot(["as_of", "entity_id"], list(names), "signal", "x")


# Features a user registers under a name: ``fn(context, schedule, universe) -> DataFrame`` with
# columns (as_of, entity_id, value).
REGISTRY: dict = {}


def register_feature(name: str):
    """Decorator that makes a feature function available by name."""

    def add(fn):
        REGISTRY[name] = fn
        return fn

    return add


def compute_registered(names, context, slots: Slots, universe: DataFrame) -> DataFrame:
    """Matrix of registered features over a universe of (as_of, entity_id)."""
    parts = [
        REGISTRY[n](context, slots, universe).select("as_of", "entity_id", F.col("value").alias(n))
        for n in names
    ]
    return feature_matrix(universe, parts, [])
