"""Reads of the fact table: what was knowable, which revision counts, what is the latest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.timeline import Slots
from pitline.schema import LOGICAL_KEY, READ_ORDER
from pitline.session import materialize


def _ts(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def as_of(
    observations: DataFrame,
    knowledge_time,
    *,
    source: str | None = None,
    dataset: str | None = None,
    entity_type: str | None = None,
    entity_id: str | None = None,
    since=None,
    latest_revision_only: bool = True,
) -> DataFrame:
    """Facts knowable by ``knowledge_time``, each logical key at its latest revision by then.

    ``since`` is an event-time floor. All predicates reach the Parquet scan.
    """
    rows = observations.where(F.col("knowledge_time") <= _ts(knowledge_time))
    wanted = {
        "source": source,
        "dataset": dataset,
        "entity_type": entity_type,
        "entity_id": entity_id,
    }
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if since is not None:
        rows = rows.where(F.col("event_time") >= _ts(since))
    return collapse_latest(rows) if latest_revision_only else rows


def collapse_latest(rows: DataFrame, key: Sequence[str] = LOGICAL_KEY) -> DataFrame:
    """One row per logical key: the newest (knowledge_time, revision), then the lowest id.

    The rank limit runs before the shuffle too, so many copies of one key shrink on the map side.
    """
    newest = W.partitionBy(*key).orderBy(
        F.col("knowledge_time").desc(), F.col("revision").desc(), "observation_id"
    )
    ranked = rows.withColumn("_rn", F.row_number().over(newest))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def read_order(rows: DataFrame) -> DataFrame:
    """Deterministic output order; only for results a person reads."""
    return rows.orderBy(*READ_ORDER, "observation_id")


def order_key(*tail: str) -> Column:
    """The read order as a comparable value, for ``max_by``."""
    return F.struct(*READ_ORDER, *tail)


def with_validity(
    observations: DataFrame, key: Sequence[str] = LOGICAL_KEY, chunk: str = "quarter",
    repeated: str | None = None,
) -> DataFrame:
    """Add ``known_until``: when a newer version of the same key became knowable (else null).

    ``as_of(K)`` is then ``knowledge_time <= K and (known_until is null or known_until > K)`` for
    every K at once. The next version is looked up inside a (key, ``chunk`` of time) window and,
    for the last version of a chunk, from the first version of the key's next chunk, so a key
    that owns a large share of all rows is spread over many tasks. ``repeated`` names a flag of the rows whose
    key occurs again, where the source knows it; it may mark others too and is left out of the result.
    """
    # A missing reference equals another missing one: a stand-in keeps the join and the window on
    # the same plain columns, so the rows are shuffled once for both.
    rows = observations.withColumn("_chunk", F.date_trunc(chunk, F.col("knowledge_time")))
    keys = list(key)
    if "ref" in keys:
        rows = rows.withColumn("_ref", F.coalesce(F.col("ref"), F.lit("\0")))
        keys[keys.index("ref")] = "_ref"
    # Only rows whose key occurs again need the look-up. Hashes of the keys are counted, which moves a
    # number per row; keys that merely share a hash are told apart by the look-up itself.
    if repeated is None:
        rows = rows.withColumn("_key", F.xxhash64(*keys))
        again = materialize(
            rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
        )
        once, more = rows.join(again, "_key", "left_anti"), rows.join(again, "_key", "left_semi")
    else:
        once, more = rows.where(~F.col(repeated)), rows.where(repeated)
    once = once.withColumn("known_until", F.lit(None).cast("timestamp"))
    more = materialize(more)
    following = W.partitionBy(*keys).orderBy("_chunk")
    heads = (
        more.groupBy(*keys, "_chunk")
        .agg(F.min("knowledge_time").alias("_first"))
        .withColumn("_next_chunk", F.lead("_first").over(following))
        .drop("_first")
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(
        F.col("knowledge_time"), F.col("revision"), F.col("observation_id").desc()
    )
    next_version = F.coalesce(F.lead("knowledge_time").over(inside), F.col("_next_chunk"))
    replaced = more.join(heads, [*keys, "_chunk"], "left").withColumn("known_until", next_version)
    out = [*(c for c in observations.columns if c != repeated), "known_until"]
    return once.select(*out).unionByName(replaced.select(*out))


def versions(observations: DataFrame) -> DataFrame:
    """``with_validity`` of facts that don't have their ``known_until`` yet."""
    return observations if "known_until" in observations.columns else with_validity(observations)


def as_of_many(
    observations: DataFrame, slots: Slots, key: Sequence[str] = LOGICAL_KEY
) -> DataFrame:
    """``as_of`` for every decision time of a schedule: one row per (as_of, visible fact)."""
    visible = slots.spans(with_validity(observations, key), "knowledge_time", "known_until")
    rows = visible.withColumn("k", F.explode(F.sequence(F.col("k_from"), F.col("k_to") - 1)))
    return slots.with_as_of(rows.drop("k_from", "k_to", "known_until"))


def visible_counts(
    observations: DataFrame, slots: Slots, by: Sequence[str], sums: dict[str, Column] | None = None
) -> DataFrame:
    """Size (and sums) of ``as_of`` per group at every decision time, without building its rows."""
    visible = slots.spans(versions(observations), "knowledge_time", "known_until")
    return slots.with_as_of(slots.rolling_sums(visible, by, sums or {}))


def latest_per_entity(
    rows: DataFrame, value: str, by: Sequence[str] = ("entity_id",), out: str = "latest"
) -> DataFrame:
    """Last non-null value of each entity in read order."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(F.max_by(value, order_key("observation_id")).alias(out))


def latest_per_entity_at(
    rows: DataFrame, slots: Slots, value: str, by: Sequence[str] = ("entity_id",)
) -> DataFrame:
    """``latest_per_entity`` at every decision time.

    The last row in read order always survives the revision collapse, so none is needed.
    """
    known = rows.where(F.col(value).isNotNull())
    filled = slots.latest(known, by, "knowledge_time", [value], order_key("observation_id"))
    return slots.with_as_of(filled)


def latest_state(rows: DataFrame, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """The newest state record of each entity by event time."""
    newest = W.partitionBy(*by).orderBy(
        F.col("event_time").desc(), F.col("knowledge_time").desc(), "observation_id"
    )
    ranked = rows.withColumn("_rn", F.row_number().over(newest))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def open_positions(states: DataFrame) -> DataFrame:
    """Entities whose latest state is ``open``."""
    return latest_state(states).where(F.col("status") == "open")


def acted_stories(states: DataFrame) -> DataFrame:
    """Distinct stories a sleeve has acted on."""
    return states.where(F.col("story_hash") != "").select("story_hash").distinct()


def last_actions(states: DataFrame) -> DataFrame:
    """Time of the last action per entity."""
    return states.groupBy("entity_id").agg(F.max("event_time").alias("last_action"))


def tradable_at(prices: DataFrame, slots: Slots) -> DataFrame:
    """Universe of a price view: entities with any price known by each decision time."""
    first = prices.where(F.col("close").isNotNull()).groupBy("entity_id").agg(
        F.min(F.greatest("knowledge_time", "event_time")).alias("_first")
    )
    seen = slots.assign(first, "_first", "k0").where(F.col("k0") < slots.n)
    rows = seen.withColumn("k", F.explode(F.sequence(F.col("k0"), F.lit(slots.n - 1))))
    return slots.with_as_of(rows.select("entity_id", "k"))
