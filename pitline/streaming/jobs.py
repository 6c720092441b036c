"""Structured Streaming versions of the polling loops.

Sources are any streaming DataFrame; the batch operators are reused per micro-batch wherever a
result spans entities.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pitline.operators.orders import advance
from pitline.session import scratch_path
from pitline.sources.store import Store


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None):
    """Stream of one Parquet table (``<folder>/<name>.parquet``), with the table's own schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is available, write it to the shared folder and read the result back."""
    spark = stream.sparkSession
    out, marks = scratch_path(spark), scratch_path(spark)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", marks)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], marks: str | None = None
) -> StreamingQuery:
    """Process what is available through ``foreachBatch`` and wait for it.

    ``marks`` is the checkpoint folder, a fresh one by default.
    """
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", marks or scratch_path(stream.sparkSession))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def final_state(stream: DataFrame, *keys: str) -> DataFrame:
    """Run an aggregating stream in update mode and return the last row of every key.

    Unlike append mode this also holds what the watermark has not closed yet.
    """
    spark = stream.sparkSession
    out = scratch_path(spark)

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(out)

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(append)
        .option("checkpointLocation", scratch_path(spark))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rest = F.struct(*[c for c in stream.columns if c not in keys])
    last = spark.read.parquet(out).groupBy(*keys).agg(F.max_by(rest, "_batch").alias("_last"))
    return last.select(*keys, "_last.*")


def ingest(
    stream: DataFrame, path: str, sequence: str | None = None, late: str | None = None,
    delay: str = "3 days", name: str | None = None, marks: str | None = None,
) -> StreamingQuery:
    """Upsert every micro-batch into the store at ``path`` as one version, the last copy of an id wins.

    ``sequence`` is a column that orders the copies inside a batch. No row is dropped for being late:
    the store takes it like any other, and with ``late`` rows that are older than the newest stored
    fact by more than ``delay`` are also written there, in a folder per batch. A version notes the last
    batch of the stream ``name``, so a batch that is replayed after it was published is skipped, and one that
    failed before starts again and overwrites its late rows. ``marks`` is the checkpoint of a stream
    that is to be resumed; its name then has to stay the same too.
    """
    name = name or uuid.uuid4().hex

    def merge(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path)
        base = store.snapshot()
        if base["applied"].get(name, -1) >= number:
            return
        newest = store.newest(base)
        if late and newest is not None:
            old = F.col("knowledge_time") < F.timestamp_micros(F.lit(newest)) - F.expr(f"interval {delay}")
            batch.where(old).write.mode("overwrite").parquet(f"{late}/batch={name}-{number:012d}")
        store.commit(batch, sequence, (name, number))

    return run_batches(stream, merge, marks)


def news_windows(articles: DataFrame, baseline: str = "14 days", slide: str = "1 day",
                 delay: str = "1 day") -> DataFrame:
    """Article counts and tone per entity in sliding windows; the last ``slide`` is the recent part."""
    window = F.window("event_time", baseline, slide)
    recent = F.col("event_time") >= F.col("window.end") - F.expr(f"interval {slide}")
    counted = articles.withWatermark("event_time", delay).withColumn("window", window)
    return counted.groupBy("window", "entity_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(recent, 1)).alias("n_recent"),
        F.avg(F.when(recent, F.col("tone"))).alias("recent_tone"),
    )


def minute_bars(ticks: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Tumbling open/high/low/close bars from ticks ``(entity_id, event_time, price, volume)``."""
    at = F.struct("event_time", "seq")
    return (
        ticks.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", width), "entity_id")
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("volume").alias("volume"),
        )
    )


def freshness(facts: DataFrame) -> DataFrame:
    """Newest knowledge time per source, for update mode."""
    return facts.groupBy("source").agg(F.max("knowledge_time").alias("last_knowledge_time"))


# --- confirmation gate -------------------------------------------------------------------------

CONFIRM_STATE = "directions array<int>, last_action timestamp"
CONFIRM_OUTPUT = "entity_id string, event_time timestamp, action int"


CONFIRM = {"persistence": 3, "sigma": 2.0, "volume": 1.5, "agree": True, "cooldown": 30.0}


def spaced(times: np.ndarray, last, cooldown: float) -> list[int]:
    """Positions of the sorted times that act when each action starts a cooldown (minutes)."""
    gap, kept = np.timedelta64(int(cooldown * 60e9), "ns"), []
    i = 0 if last is None else int(np.searchsorted(times, last + gap))
    while i < len(times):
        kept.append(i)
        i = max(i + 1, int(np.searchsorted(times, times[i] + gap)))
    return kept


def confirmed(checks: pd.DataFrame, directions: list[int], last, cfg: dict):
    """``(acting rows' positions, their directions, directions to carry on, last action)`` of one
    name's checks in time order.

    A check's direction is the sign of a move beyond ``sigma`` volatilities. It is a candidate if the
    last ``persistence`` directions, those carried on included, are all the same, volume is elevated
    and the daily signal isn't opposed; candidates act outside the cooldown of the last action.
    """
    n = max(1, int(cfg["persistence"]))
    signal, daily = checks["signal"].to_numpy(float), checks["daily_signal"].to_numpy(float)
    bar = cfg["sigma"] * np.maximum(checks["recent_vol"].to_numpy(float), 0.0)
    now = np.where((bar > 0) & (np.abs(signal) >= bar), np.sign(signal), 0.0)
    every = np.concatenate([np.asarray(directions, dtype=float), now])
    sums = np.concatenate([[0.0], np.cumsum(every)])
    stop = np.arange(len(every) - len(now), len(every)) + 1
    steady = (stop >= n) & (np.abs(sums[stop] - sums[np.maximum(stop - n, 0)]) == n)
    loud = checks["volume_ratio"].to_numpy(float) >= cfg["volume"]
    agreed = ~(bool(cfg["agree"]) & (now * daily < 0))
    at = np.flatnonzero(steady & loud & agreed)
    times = checks["event_time"].to_numpy("datetime64[ns]")
    acts = at[spaced(times[at], last, cfg["cooldown"])]
    carried = every[-n:].astype(int).tolist()
    return acts, now[acts].astype(int), carried, times[acts[-1]] if len(acts) else last


def confirmations(checks: DataFrame, **settings) -> DataFrame:
    """Confirmed actions from a stream of checks ``(entity_id, event_time, signal, recent_vol,
    volume_ratio, daily_signal)``.

    The state per name is its last few directions and its last action. Checks of one micro-batch
    are taken in time order.
    """
    cfg = {**CONFIRM, **settings}

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else ((), None)
        rows = pd.concat(list(frames)).sort_values("event_time")
        last = None if last is None else np.datetime64(pd.Timestamp(last).to_datetime64(), "ns")
        acts, actions, carried, last = confirmed(rows, list(held), last, cfg)
        state.update((carried, None if last is None else pd.Timestamp(last).to_pydatetime()))
        yield pd.DataFrame(
            {"entity_id": key[0], "event_time": rows["event_time"].to_numpy()[acts],
             "action": actions}, index=range(len(acts)),
        )

    return checks.groupBy("entity_id").applyInPandasWithState(
        update, CONFIRM_OUTPUT, CONFIRM_STATE, "append", GroupStateTimeout.NoTimeout
    )


def confirmations_batch(checks: DataFrame, **settings) -> DataFrame:
    """The same gate over a finished history of checks.

    Only checks that pass everything but the cooldown can act, and those are found with window
    functions. The cooldown walk then streams over these few candidates.
    """
    from pyspark.sql import Window as W

    cfg = {**CONFIRM, **settings}
    n = max(1, cfg["persistence"])
    bar = cfg["sigma"] * F.greatest(F.col("recent_vol"), F.lit(0.0))
    now = F.when((bar > 0) & (F.abs("signal") >= bar), F.when(F.col("signal") > 0, 1).otherwise(-1))
    w = W.partitionBy("entity_id").orderBy("event_time").rowsBetween(-(n - 1), 0)
    marked = checks.withColumn("_d", F.coalesce(now, F.lit(0)))
    marked = marked.withColumns(
        {"_sum": F.sum("_d").over(w), "_n": F.count(F.lit(1)).over(w)}
    )
    candidates = marked.where(
        (F.col("_n") == n)
        & (F.abs("_sum") == n)
        & (F.col("volume_ratio") >= cfg["volume"])
        & ~(F.lit(cfg["agree"]) & (F.col("_d") * F.col("daily_signal") < 0))
    ).select("entity_id", "event_time", F.col("_d").alias("action"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows arrive by name and time; only the last action of the current name is kept, and
        # the walk jumps from one action to the next.
        name, last = None, None
        for batch in batches:
            kept = []
            for key, rows in batch.groupby("entity_id", sort=False):
                if key != name:
                    name, last = key, None
                times = rows["event_time"].to_numpy("datetime64[ns]")
                acts = spaced(times, last, cfg["cooldown"])
                kept += list(rows.index[acts])
                last = times[acts[-1]] if acts else last
            yield batch.loc[kept]

    ordered = candidates.repartition("entity_id").sortWithinPartitions("entity_id", "event_time")
    return ordered.mapInPandas(walk, CONFIRM_OUTPUT)


# --- sleeve lifecycle --------------------------------------------------------------------------

SLEEVE_STATE = (
    "status string, direction int, entry_price double, exit_by timestamp, last_action timestamp, "
    "stories array<string>, opened array<bigint>"
)
SLEEVE_OUTPUT = (
    "entity_id string, event_time timestamp, status string, direction int, price double, "
    "exit_by timestamp, story_hash string, confidence double, reason string"
)


@dataclass(frozen=True)
class SleeveRules:
    """Holding time and cooldown in days, adverse move that stops, least confidence, and for how
    many days a story counts as used."""

    hold_days: float = 5.0
    stop: float = 0.0
    cooldown_days: float = 0.0
    min_confidence: float = 0.0
    remember_days: float = 30.0


def _span(days: float) -> np.timedelta64:
    return np.timedelta64(int(days * 86_400e6), "us")


def flat_state() -> dict:
    return {"status": "flat", "direction": 0, "entry_price": 0.0, "exit_by": None,
            "last_action": None, "stories": {}}


def sleeve_actions(held: dict, rows: pd.DataFrame, rules: SleeveRules) -> list[tuple]:
    """Actions of one name on its messages in time order; ``held`` is carried on.

    Closing and opening conditions are columns over all messages; the loop jumps from one action to
    the next. A message that closes a position may open the next one.
    """
    times = rows["event_time"].to_numpy("datetime64[us]")
    price = np.nan_to_num(rows["price"].to_numpy(float))
    side = np.sign(np.nan_to_num(rows["direction"].to_numpy(float))).astype(int)
    sure = np.nan_to_num(rows["confidence"].to_numpy(float))
    story = rows["story_hash"].fillna("").to_numpy(dtype=object)
    tells = (story != "") & (price > 0) & (side != 0) & (sure >= rules.min_confidence)
    out, i = [], 0
    while i < len(times):
        if held["status"] == "open":
            move = held["direction"] * (price[i:] / held["entry_price"] - 1.0)
            stopped = (price[i:] > 0) & (rules.stop > 0) & (move <= -rules.stop)
            ends = np.flatnonzero(stopped | (times[i:] >= held["exit_by"]))
            if not len(ends):
                break
            reason = "stop" if stopped[ends[0]] else "horizon"
            i += int(ends[0])
            out.append((times[i], "closed", held["direction"], price[i], None, None, None, reason))
            held.update(status="closed", last_action=times[i])
        else:
            ready = tells[i:].copy()
            if held["last_action"] is not None:
                ready &= times[i:] >= held["last_action"] + _span(rules.cooldown_days)
            at = next((k for k in np.flatnonzero(ready) if story[i + k] not in held["stories"]), None)
            if at is None:
                break
            i += int(at)
            due = times[i] + _span(rules.hold_days)
            out.append((times[i], "open", side[i], price[i], due, story[i], sure[i], None))
            held.update(status="open", direction=int(side[i]), entry_price=float(price[i]),
                        exit_by=due, last_action=times[i])
            held["stories"][story[i]] = times[i]
            i += 1
    if len(times):
        oldest = times[-1] - _span(rules.remember_days)
        held["stories"] = {s: t for s, t in held["stories"].items() if t >= oldest}
    return out


def sleeve(messages: DataFrame, rules: SleeveRules = SleeveRules()) -> DataFrame:
    """Open and close events per name from a stream of ``(entity_id, event_time, price, story_hash,
    direction, confidence)``; an open position also closes when event time passes its exit."""

    def stamp(t):
        return None if t is None else np.datetime64(pd.Timestamp(t).to_datetime64(), "us")

    def plain(t):
        return None if t is None else pd.Timestamp(t).to_pydatetime()

    def update(key, frames, state: GroupState) -> Iterator[pd.DataFrame]:
        held = flat_state()
        if state.exists:
            status, side, entry, exit_by, last, stories, opened = state.get
            seen = {s: np.datetime64(int(t), "us") for s, t in zip(stories, opened, strict=True)}
            held.update(status=status, direction=side, entry_price=entry, exit_by=stamp(exit_by),
                        last_action=stamp(last), stories=seen)
        if state.hasTimedOut:
            found = []
            if held["status"] == "open":
                at = held["exit_by"]
                found = [(at, "closed", held["direction"], None, None, None, None, "horizon")]
                held.update(status="closed", last_action=at)
        else:
            rows = pd.concat(list(frames)).sort_values("event_time")
            found = sleeve_actions(held, rows, rules)
        state.update((
            held["status"], held["direction"], held["entry_price"], plain(held["exit_by"]),
            plain(held["last_action"]), list(held["stories"]),
            [int(t.astype("datetime64[us]").astype(np.int64)) for t in held["stories"].values()],
        ))
        if held["status"] == "open":
            due = int(held["exit_by"].astype("datetime64[ms]").astype(np.int64))
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
        cols = ["event_time", "status", "direction", "price", "exit_by", "story_hash", "confidence",
                "reason"]
        yield pd.DataFrame(found, columns=cols).assign(entity_id=key[0])[
            ["entity_id", *cols]
        ].astype({"direction": "int32", "price": "float64", "confidence": "float64",
                  "event_time": "datetime64[ns]", "exit_by": "datetime64[ns]"})

    marked = messages.withWatermark("event_time", "1 day")
    return marked.groupBy("entity_id").applyInPandasWithState(
        update, SLEEVE_OUTPUT, SLEEVE_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def cap_openings(candidates: DataFrame, held: DataFrame, max_names: int) -> DataFrame:
    """Openings allowed per decision time by the free slots, most confident first (for
    ``foreachBatch``: a cap over all names cannot live in per-name state)."""
    from pyspark.sql import Window as W

    taken = held.agg(F.count(F.lit(1))).scalar()
    w = W.partitionBy("as_of").orderBy(F.col("confidence").desc(), "entity_id")
    fresh = candidates.join(held.select("entity_id"), "entity_id", "left_anti")
    ranked = fresh.withColumn("_rn", F.row_number().over(w))
    return ranked.where(F.col("_rn") <= F.lit(max_names) - taken).drop("_rn")


# --- ledger ------------------------------------------------------------------------------------


def positions(fills: DataFrame) -> DataFrame:
    """Position of each (account, entity) after every micro-batch of fills ``(account, entity_id,
    event_time, seq, signed_qty, price)``."""

    def update(key, frames, state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["event_time", "seq"])
        held = advance(held, rows["signed_qty"], rows["price"])
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
        qty, avg = held or (0.0, 0.0)
        yield pd.DataFrame(
            {"account": [key[0]], "entity_id": [key[1]], "qty": [qty], "avg_price": [avg],
             "event_time": [rows["event_time"].max()]}
        )

    return fills.groupBy("account", "entity_id").applyInPandasWithState(
        update,
        "account string, entity_id string, qty double, avg_price double, event_time timestamp",
        "qty double, avg_price double",
        "update",
        GroupStateTimeout.NoTimeout,
    )
