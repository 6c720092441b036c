"""Streams whose passes look at a window of recent bars or at all names together."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitline import schema as sm
from pitline.sources import ledger as lg
from pitline.sources.store import Store
from pitline.streaming.jobs import SleeveRules, run_batches

# --- features of the last bars -----------------------------------------------------------------

FEATURES = (
    "entity_id string, event_time timestamp, close double, momentum double, mean_reversion double, "
    "volatility double"
)
BUFFER = "steps array<bigint>, closes array<double>, at array<bigint>, seq array<bigint>"


@dataclass(frozen=True)
class Intraday:
    """Seconds of a bar, bars that are remembered, and the features' look-backs in bars."""

    step: int = 60
    span: int = 180
    momentum: int = 30
    mean_reversion: int = 5
    volatility: int = 30


def bar_features(steps: np.ndarray, closes: np.ndarray, rules: Intraday) -> dict[str, np.ndarray]:
    """Features at every bar of one name, from bars less than ``span`` steps old.

    Between bars the last price counts, so look-backs are in steps of time. Returns are 0 in a step without
    a bar and start at the second bar of the span.
    """
    n = np.arange(len(steps))
    oldest = np.searchsorted(steps, steps - rules.span, side="right")

    def change(back: int) -> np.ndarray:
        at = np.searchsorted(steps, steps - back, side="right") - 1
        base = np.where(at >= oldest, closes[np.maximum(at, 0)], np.nan)
        return closes / np.where(base == 0, np.nan, base) - 1.0

    before = np.concatenate([[np.nan], closes[:-1]])
    moves = np.nan_to_num(closes / np.where(before == 0, np.nan, before) - 1.0)
    start = np.maximum(np.searchsorted(steps, steps - rules.volatility, side="right"), oldest + 1)
    start = np.minimum(start, n + 1)
    known = np.minimum(rules.volatility, steps - steps[oldest])

    def total(x: np.ndarray) -> np.ndarray:  # of x[start : n + 1], without cancellation
        ends = np.stack([start, n + 1], axis=1).ravel()
        return np.where(start <= n, np.add.reduceat(np.append(x, 0.0), ends)[::2], 0.0) if len(x) else x

    with np.errstate(invalid="ignore", divide="ignore"):
        mean = total(moves) / known
        spread = total(moves * moves) / known - mean * mean
    return {
        "momentum": change(rules.momentum), "mean_reversion": -change(rules.mean_reversion),
        "volatility": np.where(known > 0, np.sqrt(np.maximum(spread, 0.0)), np.nan),
    }


def minute_features(ticks: DataFrame, rules: Intraday = Intraday(), delay: str = "10 minutes") -> DataFrame:
    """Features of every bar from a stream of ticks ``(entity_id, event_time, seq, price)``, for update mode.

    The state of a name is the closes of its last ``span`` steps; what is older goes, and a name that has
    been silent for so long is forgotten by an event-time timer. A pass emits the bars it touched and
    those after them, so the last row of a bar doesn't depend on how ticks were cut into batches. The
    ticks of a batch are reduced to bars as they are read.
    """

    def update(key, frames, state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bars: dict[int, tuple] = {}
        if state.exists:
            bars = {s: (at, seq, close) for s, close, at, seq in zip(*state.get)}
        touched = None
        for rows in frames:
            micros = rows["event_time"].to_numpy("datetime64[us]").astype(np.int64)
            for at, seq, price in zip(micros.tolist(), rows["seq"].tolist(), rows["price"].tolist()):
                s = at // (rules.step * 1_000_000)
                if s not in bars or bars[s][:2] <= (at, seq):
                    bars[s] = (at, seq, price)
                    touched = s if touched is None else min(s, touched)
        steps = np.array(sorted(bars), dtype=np.int64)
        closes = np.array([bars[s][2] for s in steps.tolist()])
        if touched is not None:
            new = steps >= touched
            found = {n: c[new] for n, c in bar_features(steps, closes, rules).items()}
            yield pd.DataFrame({
                "entity_id": key[0], "event_time": pd.to_datetime(steps[new] * rules.step, unit="s"),
                "close": closes[new], **found,
            })
        kept = [s for s in steps.tolist() if s > steps[-1] - 2 * rules.span]
        state.update((kept, [bars[s][2] for s in kept], [bars[s][0] for s in kept], [bars[s][1] for s in kept]))
        due = int(steps[-1] + rules.span) * rules.step * 1000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)

    return ticks.withWatermark("event_time", delay).groupBy("entity_id").applyInPandasWithState(
        update, FEATURES, BUFFER, "update", GroupStateTimeout.EventTimeTimeout
    )


# --- a sleeve with a cap over all names ---------------------------------------------------------


def sleeve_pass(
    batch: DataFrame, facts: DataFrame | None, rules: SleeveRules, max_names: int
) -> DataFrame:
    """What one pass over all names does: ``(as_of, entity_id, status, entry_price, exit_by, reason,
    story_hash)``.

    Positions close at their exit time or stop first. Each name's most confident positive message may
    then open one, unless its story was used, the name is held or cools down; the free slots
    go to the most confident. ``facts`` is the ledger so far; as_of is the newest time of the batch.
    """
    now = batch.agg(F.max("event_time")).scalar()
    quotes = batch.where(F.col("price") > 0).groupBy("entity_id").agg(
        F.max_by("price", F.struct("event_time", "price")).alias("price")
    )
    best = F.struct(F.col("confidence"), (-F.unix_micros("event_time")).alias("_t"), F.col("story_hash"))
    told = batch.where(
        (F.coalesce("story_hash", F.lit("")) != "") & (F.col("direction") > 0)
        & (F.col("confidence") >= rules.min_confidence)
    ).groupBy("entity_id").agg(F.max(best).alias("_b")).select("entity_id", "_b.confidence", "_b.story_hash")
    asked = told.join(quotes, "entity_id").withColumn("as_of", now)
    spark = batch.sparkSession
    if facts is None:
        log = spark.createDataFrame(
            [], "entity_id string, event_time timestamp, status string, entry_price double, exit_by timestamp, "
            "reason string, story_hash string",
        )
    else:
        log = sm.typed_view(facts, sm.NEWS_SLEEVE).withColumn("exit_by", F.try_to_timestamp("exit_by"))
    last = log.groupBy("entity_id").agg(
        F.max_by(F.struct("status", "entry_price", "exit_by", "story_hash"),
                 F.struct("event_time", (F.col("status") == "open"))).alias("_s"),
        F.max("event_time").alias("last_action"),
    ).select("entity_id", "last_action", "_s.*")
    held = last.where(F.col("status") == "open").join(quotes, "entity_id", "left").withColumn("as_of", now)
    move = F.try_divide("price", "entry_price") - 1.0
    stopped = F.coalesce((F.col("entry_price") > 0) & F.lit(rules.stop > 0) & (move <= -rules.stop), F.lit(False))
    judged = held.withColumn("_stop", stopped).withColumn(
        "_out", F.col("_stop") | (F.col("as_of") >= F.col("exit_by"))
    )
    closes = judged.where("_out").select(
        "as_of", "entity_id", F.lit("closed").alias("status"), F.col("price").alias("entry_price"), "exit_by",
        F.when(F.col("_stop"), "stop").otherwise("horizon").alias("reason"), "story_hash",
    )
    live = judged.where("NOT _out").select("entity_id")
    free = max(0, max_names - live.count())
    cooled = F.col("last_action").isNull() | (
        F.unix_micros("as_of") - F.unix_micros("last_action") >= int(rules.cooldown_days * 86_400e6)
    )
    opens = (
        asked.join(log.select("story_hash").distinct(), "story_hash", "left_anti")
        .join(live, "entity_id", "left_anti").join(last.select("entity_id", "last_action"), "entity_id", "left")
        .where(cooled).orderBy(F.desc("confidence"), "entity_id").limit(free)
        .select("as_of", "entity_id", F.lit("open").alias("status"), F.col("price").alias("entry_price"),
                (F.col("as_of") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(rules.hold_days * 86400.0)))
                .alias("exit_by"), F.lit(None).cast("string").alias("reason"), "story_hash")
    )
    return closes.unionByName(opens)


def capped_sleeve(
    messages: DataFrame, path: str, rules: SleeveRules, max_names: int, name: str | None = None,
    marks: str | None = None,
) -> StreamingQuery:
    """Run the passes of a stream of ``(entity_id, event_time, price, story_hash, direction, confidence)``.

    A cap over all names can't live in the state of one name: each micro-batch is a pass over all of
    them, and its actions are one version of the ledger at ``path``. The version notes the batch, so
    a replayed pass does nothing.
    """
    name = name or uuid.uuid4().hex

    def each(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path)
        if store.snapshot()["applied"].get(name, -1) >= number or batch.isEmpty():
            return
        batch.persist()
        try:
            actions = sleeve_pass(batch, store.read(), rules, max_names)
            store.commit(lg.sleeve_facts(actions), applied=(name, number))
        finally:
            batch.unpersist()

    return run_batches(messages, each, marks)
