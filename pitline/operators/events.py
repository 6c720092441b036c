"""Event detection over a schedule of scan times, alerts and news surges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.scalars import news_confidence, story_key, whole_days
from pitline.functions.timeline import Slots
from pitline.operators.bitemporal import versions, with_validity
from pitline.operators.features import days

# The event vocabulary.
EVENT_TYPES = (
    "earnings_beat", "earnings_miss", "cpi_surprise", "fed_surprise", "guidance_change",
    "m_and_a", "regulatory_action", "geopolitical_shock", "insider_cluster_buy",
    "leadership_congress_trade", "news_sentiment_spike",
)
CLUSTER = "insider_cluster_buy"
LEADERSHIP = "leadership_congress_trade"


def insider_clusters(
    filings: DataFrame, slots: Slots, threshold: int = 3, window_days: int = 30
) -> DataFrame:
    """Names with at least ``threshold`` purchases known within the window, per scan time."""
    buys = versions(filings).where(F.col("is_purchase"))
    expiry = F.least(F.col("knowledge_time") + days(window_days), F.col("known_until"))
    spans = slots.spans(buys, "knowledge_time", expiry)
    seen = slots.rolling_agg(
        spans,
        ["entity_id"],
        {
            "n": F.count(F.lit(1)),
            "et": F.max("event_time"),
            "kt": F.max("knowledge_time"),
        },
        {
            "n_buys": F.sum("n"),
            "event_time": F.max("et"),
            "knowledge_time": F.max("kt"),
        },
    ).where(F.col("n_buys") >= threshold)
    return slots.with_as_of(seen).select(
        "as_of", F.lit(CLUSTER).alias("event_type"), "entity_id", "event_time", "knowledge_time",
        "n_buys",
    )


def leadership_trades(trades: DataFrame) -> DataFrame:
    """Trades by high-signal office holders, with the time until which each version is visible."""
    return versions(trades).where(F.col("high_signal_role")).withColumn(
        "event_type", F.lit(LEADERSHIP)
    )


def detect_events(
    filings: DataFrame, trades: DataFrame, slots: Slots, threshold: int = 3, window_days: int = 30
) -> DataFrame:
    """All events visible at each scan time.

    Leadership trades have no window, so each is repeated at every later scan: use ``anchors``
    when only first sightings matter, and ``event_counts`` when equal events may be counted.
    """
    clusters = insider_clusters(filings, slots, threshold, window_days)
    spans = slots.spans(leadership_trades(trades), "knowledge_time", "known_until")
    seen = spans.withColumn("k", F.explode(F.sequence(F.col("k_from"), F.col("k_to") - 1)))
    led = slots.with_as_of(seen).select(
        "as_of", "event_type", "entity_id", "event_time", "knowledge_time", "transaction_type"
    )
    return clusters.unionByName(led, allowMissingColumns=True)


def event_counts(
    filings: DataFrame, trades: DataFrame, slots: Slots, threshold: int = 3, window_days: int = 30
) -> DataFrame:
    """Equal events of a scan as one row with their number ``n``.

    Events are equal by type, name and, of leadership trades, transaction type. Trades are counted
    by where they appear and disappear, so a name with many trades gives no more rows than one.
    """
    clusters = insider_clusters(filings, slots, threshold, window_days).select(
        "as_of", "event_type", "entity_id", "n_buys", F.lit(1).cast("long").alias("n")
    )
    spans = slots.spans(leadership_trades(trades), "knowledge_time", "known_until")
    led = slots.with_as_of(slots.rolling_sums(spans, ["entity_id", "transaction_type"], {})).select(
        "as_of", F.lit(LEADERSHIP).alias("event_type"), "entity_id", "transaction_type",
        F.col("n_visible").cast("long").alias("n"),
    )
    return clusters.unionByName(led, allowMissingColumns=True)


def event_entities(
    filings: DataFrame, trades: DataFrame, slots: Slots, threshold: int = 3, window_days: int = 30
) -> DataFrame:
    """The distinct names with events at each scan: ``(as_of, entity_id, event_types, n_events)``.

    Leadership trades are counted by where they appear and disappear, not repeated at every scan.
    """
    clusters = insider_clusters(filings, slots, threshold, window_days).select(
        "as_of", "entity_id", "event_type", F.lit(1).alias("n")
    )
    spans = slots.spans(leadership_trades(trades), "knowledge_time", "known_until")
    led = slots.with_as_of(slots.rolling_sums(spans, ["entity_id"], {})).select(
        "as_of", "entity_id", F.lit(LEADERSHIP).alias("event_type"), F.col("n_visible").alias("n")
    )
    return clusters.unionByName(led).groupBy("as_of", "entity_id").agg(
        F.sort_array(F.collect_set("event_type")).alias("event_types"), F.sum("n").alias("n_events")
    )


def anchors(
    filings: DataFrame, trades: DataFrame, slots: Slots, threshold: int = 3, window_days: int = 30
) -> DataFrame:
    """Each event once, at the first scan that saw it: ``(event_type, entity_id, anchor, as_of)``.

    An event is identified by entity, type and knowledge time.
    """
    clusters = insider_clusters(filings, slots, threshold, window_days).groupBy(
        "event_type", "entity_id", F.col("knowledge_time").alias("anchor")
    ).agg(F.min("as_of").alias("as_of"))
    spans = slots.spans(leadership_trades(trades), "knowledge_time", "known_until")
    first = spans.groupBy("event_type", "entity_id", F.col("knowledge_time").alias("anchor")).agg(
        F.min("k_from").alias("k")
    )
    return clusters.unionByName(slots.with_as_of(first))


def cluster_entries(
    clusters: DataFrame,
    gate: DataFrame,
    held: DataFrame | None = None,
    hold_days: int = 5,
    max_names: int = 5,
    freshness_days: int = 5,
) -> DataFrame:
    """Fresh clusters to enter per scan time, newest first, none unless the gate holds the type.

    ``gate`` is ``(event_type, mean_car)`` of the types that passed; ``held`` is ``(entity_id)``
    or ``(as_of, entity_id)``.
    """
    open_gate = gate.where(F.col("mean_car") > 0).select("event_type", "mean_car")
    fresh = clusters.join(open_gate, "event_type").where(
        whole_days("as_of", "knowledge_time") <= freshness_days
    )
    if held is not None:
        fresh = fresh.join(held, [c for c in ("as_of", "entity_id") if c in held.columns],
                           "left_anti")
    newest = W.partitionBy("as_of").orderBy(F.col("knowledge_time").desc(), "entity_id")
    ranked = fresh.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= max_names)
    return ranked.select(
        "as_of", "entity_id", "knowledge_time", (F.col("as_of") + days(hold_days)).alias("exit_by"),
        "n_buys", F.col("mean_car").alias("expected_car"),
    )


def news_surges(
    articles: DataFrame,
    slots: Slots,
    count_surge: float = 3.0,
    tone_min: float = 2.0,
    baseline_days: int = 14,
    recent_days: int = 1,
) -> DataFrame:
    """Names whose recent article count surged past their trailing daily baseline.

    Both windows include their old end. At least three recent articles are needed.
    """
    facts = with_validity(articles)

    def window(n: int) -> DataFrame:
        marked = facts.withColumn("_end", F.col("event_time") + days(n))
        marked = slots.assign(marked, "knowledge_time", "k_from")
        marked = slots.assign(marked, "_end", "_k_window", after=True)
        marked = slots.assign(marked, "known_until", "_k_version")
        return marked.withColumn("k_to", F.least("_k_window", "_k_version")).where(
            F.col("k_from") < F.col("k_to")
        )

    everything = slots.rolling_sums(window(baseline_days), ["entity_id"], {})
    newest = F.struct("event_time", "observation_id")
    recent = slots.rolling_agg(
        window(recent_days),
        ["entity_id"],
        {
            "n": F.count(F.lit(1)),
            "tone_sum": F.sum("tone"),
            "tone_n": F.count("tone"),
            "at": F.max(newest),
            "story": F.max_by(story_key("url", "title"), newest),
        },
        {
            "n_recent": F.sum("n"),
            "tone_sum": F.sum("tone_sum"),
            "tone_n": F.sum("tone_n"),
            "story_hash": F.max_by("story", "at"),
        },
    ).where(F.col("n_recent") >= 3)
    both = recent.join(everything, ["entity_id", "k"])
    per_day = (F.col("n_visible") - F.col("n_recent")) / max(baseline_days - recent_days, 1)
    both = both.withColumn("surge", F.col("n_recent") / F.greatest(per_day, F.lit(0.5)))
    tone = F.when(F.col("tone_n") > 0, F.col("tone_sum") / F.col("tone_n")).otherwise(0.0)
    both = both.where(F.col("surge") >= count_surge).withColumn("tone", tone)
    return slots.with_as_of(both).select(
        "as_of",
        "entity_id",
        F.signum("tone").cast("int").alias("direction"),
        news_confidence("surge", "tone", count_surge, tone_min).alias("confidence"),
        F.round("tone", 4).alias("tone"),
        F.round("surge", 4).alias("surge"),
        "story_hash",
        F.col("n_recent").cast("long").alias("n_recent"),
    )


def alerts(events: DataFrame) -> DataFrame:
    """Events as alerts with a level and a message; ``n`` of counted events is kept."""
    cluster = F.col("event_type") == CLUSTER
    return events.where(F.col("event_type").isin(CLUSTER, LEADERSHIP)).select(
        "as_of",
        F.when(cluster, "high").otherwise("medium").alias("level"),
        F.col("event_type").alias("kind"),
        "entity_id",
        F.when(
            cluster, F.format_string("%d insiders bought %s", F.col("n_buys"), F.col("entity_id"))
        )
        .otherwise(
            F.format_string("leadership %s in %s", F.col("transaction_type"), F.col("entity_id"))
        )
        .alias("message"),
        *[c for c in events.columns if c == "n"],
    )
