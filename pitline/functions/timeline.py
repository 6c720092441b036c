"""Decision schedules and the mapping of facts onto them.

A schedule is a small DataFrame ``(as_of, k, next_as_of)`` with ``k`` counting from 0. Facts are
mapped to schedule slots by an equi-join on a time bucket, so "everything knowable at each of N
decision dates" never becomes a range join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.session import materialize


def make_schedule(dates: DataFrame, column: str = "event_time") -> DataFrame:
    """Schedule of the distinct times in ``column``. Its size is the number of decision dates."""
    w = W.orderBy("as_of")
    return (
        dates.select(F.col(column).alias("as_of"))
        .where(F.col("as_of").isNotNull())
        .distinct()
        .select(
            "as_of",
            (F.row_number().over(w) - 1).alias("k"),
            F.lead("as_of").over(w).alias("next_as_of"),
        )
    )


def sample_dates(
    calendar: DataFrame, warmup: int = 0, every: int = 1, last: int | None = None
) -> DataFrame:
    """Every ``every``-th date after ``warmup`` dates, at most the ``last`` newest, as a schedule."""
    ordered = make_schedule(calendar)
    picked = ordered.where((F.col("k") >= warmup) & ((F.col("k") - warmup) % every == 0))
    if last is not None:
        newest = W.orderBy(F.col("as_of").desc())
        picked = picked.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last)
    return make_schedule(picked, "as_of")


def calendar_of(bars: DataFrame) -> DataFrame:
    """Distinct bar times numbered from 0, with the number of times ``n_dates`` on every row."""
    w = W.orderBy("event_time")
    span = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        bars.select("event_time")
        .distinct()
        .select(
            "event_time",
            (F.row_number().over(w) - 1).alias("t"),
            F.count(F.lit(1)).over(span).alias("n_dates"),
        )
    )


def _bucket(ts: Column, grain: str) -> Column:
    return F.date_trunc(grain, ts)


class Slots:
    """Maps timestamps to slots of one schedule.

    ``grain`` is the join bucket ("day", "hour" or "minute"): pick one that holds few decision
    times each.
    """

    def __init__(self, schedule: DataFrame, grain: str = "day") -> None:
        # One row per decision time: written once, so every use reads a tiny table whose size
        # the planner knows, instead of deriving the schedule from the data again.
        schedule = materialize(schedule.coalesce(1))
        self.schedule = schedule
        self.grain = grain
        bounds = schedule.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct(_bucket(F.col("as_of"), grain)).alias("buckets"),
            F.date_format(_bucket(F.min("as_of"), grain), "yyyy-MM-dd HH:mm:ss").alias("first"),
        ).first()
        self.n = bounds["n"]
        self.apart = bounds["buckets"] == self.n  # no two decision times share a bucket
        self.first_bucket = F.lit(bounds["first"]).cast("timestamp")
        per_bucket = schedule.groupBy(_bucket(F.col("as_of"), grain).alias("_slot_b")).agg(
            F.array_sort(F.collect_list("as_of")).alias("_slot_times"),
            F.min("k").alias("_slot_k"),
        )
        following = F.lead("_slot_b").over(W.orderBy("_slot_b"))
        step = F.expr(f"interval 1 {grain}")
        self.buckets = (
            per_bucket.withColumn("_next", F.coalesce(following - step, F.col("_slot_b")))
            .withColumn("_day", F.explode(F.sequence("_slot_b", "_next", step)))
            .select(
                F.col("_day").alias("_slot_b"),
                F.when(F.col("_day") == F.col("_slot_b"), F.col("_slot_times"))
                .otherwise(F.array().cast("array<timestamp>"))
                .alias("_slot_times"),
                F.when(F.col("_day") == F.col("_slot_b"), F.col("_slot_k"))
                .otherwise(F.col("_slot_k") + F.size("_slot_times"))
                .alias("_slot_k"),
            )
        )

    def assign(self, df: DataFrame, ts, out: str, after: bool = False) -> DataFrame:
        """Add ``out``: the first slot at or after ``ts`` (strictly after with ``after=True``).

        The number of slots means "after the whole schedule". A null time means never.
        """
        t = F.col(ts) if isinstance(ts, str) else ts
        marked = df.withColumn("_slot_t", t).withColumn(
            "_slot_b", _bucket(F.col("_slot_t"), self.grain)
        )
        x = F.col("_slot_t")
        before = (lambda a: a <= x) if after else (lambda a: a < x)
        if self.apart:  # a plain comparison, which Spark compiles with the rest of the stage
            passed = F.coalesce(before(F.get("_slot_times", F.lit(0))).cast("int"), F.lit(0))
        else:
            passed = F.size(F.filter("_slot_times", before))
        slot = (
            F.when(F.col("_slot_times").isNotNull(), F.col("_slot_k") + passed)
            .when(F.col("_slot_b") < self.first_bucket, F.lit(0))
            .otherwise(F.lit(self.n))
        )
        return (
            marked.join(self.buckets, "_slot_b", "left")
            .withColumn(out, slot.cast("int"))
            .drop("_slot_t", "_slot_b", "_slot_times", "_slot_k")
        )

    def spans(self, df: DataFrame, start, end, end_inclusive: bool = False) -> DataFrame:
        """Add the slot range ``[k_from, k_to)`` in which a fact is visible; empty ones go.

        ``end`` is exclusive unless ``end_inclusive``. A null end means visible for ever.
        """
        df = self.assign(df, start, "k_from")
        df = self.assign(df, end, "k_to", after=end_inclusive)
        return df.where(F.col("k_from") < F.col("k_to"))

    def rolling_sums(
        self, spans: DataFrame, keys: Sequence[str], sums: dict[str, Column]
    ) -> DataFrame:
        """Sum of the visible facts per key and slot, where any fact is visible.

        Each fact enters at its first slot and leaves at its last. Both are summed per (key, slot)
        before the shuffle and then accumulated, so the cost does not grow with the window.
        Output: keys, ``k``, ``n_visible`` and one column per sum.
        """
        named = {"n_visible": F.lit(1), **sums}
        flat = spans.select(
            *keys, "k_from", "k_to", *[v.alias(f"_{n}") for n, v in named.items()]
        )
        moves = flat.select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.col("k_from").alias("k"), F.lit(1).alias("s")),
                    F.struct(F.col("k_to").alias("k"), F.lit(-1).alias("s")),
                )
            ).alias("_m"),
            *[f"_{n}" for n in named],
        ).where(F.col("_m.k") < self.n)
        moves = moves.groupBy(*keys, F.col("_m.k").alias("k")).agg(
            *[F.sum(F.col(f"_{n}") * F.col("_m.s")).alias(n) for n in named]
        )
        w = W.partitionBy(*keys).orderBy("k")
        upto = w.rowsBetween(W.unboundedPreceding, 0)
        totals = moves.select(
            *keys,
            "k",
            F.coalesce(F.lead("k").over(w), F.lit(self.n)).alias("_next"),
            *[F.sum(n).over(upto).alias(n) for n in named],
        ).where(F.col("n_visible") > 0)
        return totals.select(
            *keys,
            F.explode(F.sequence(F.col("k"), F.col("_next") - 1)).alias("k"),
            *named,
        )

    def rolling_agg(
        self, spans: DataFrame, keys: Sequence[str], first: dict[str, Column], then: dict[str, Column]
    ) -> DataFrame:
        """Aggregates that cannot be subtracted (max, min, ...) over the visible facts per slot.

        ``first`` combines facts with the same key and slot range, ``then`` combines those
        partial results per slot. Only partial results are repeated over slots, so use it for
        windows that span few slots.
        """
        partial = spans.groupBy(*keys, "k_from", "k_to").agg(
            *[v.alias(n) for n, v in first.items()]
        )
        return (
            partial.withColumn("k", F.explode(F.sequence(F.col("k_from"), F.col("k_to") - 1)))
            .groupBy(*keys, "k")
            .agg(*[v.alias(n) for n, v in then.items()])
        )

    def latest(
        self, df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], order: Column
    ) -> DataFrame:
        """Latest row (by ``order``) known at each slot, carried forward.

        Output: keys, ``k`` and the values.
        """
        seen = self.assign(df, ts, "k").where(F.col("k") < self.n)
        best = seen.groupBy(*keys, "k").agg(
            F.max_by(F.struct(*values), order).alias("_v"), F.max(order).alias("_o")
        )
        w = W.partitionBy(*keys).orderBy("k")
        best = best.withColumn(
            "_v", F.max_by("_v", "_o").over(w.rowsBetween(W.unboundedPreceding, 0))
        ).withColumn("_next", F.coalesce(F.lead("k").over(w), F.lit(self.n)))
        return best.select(
            *keys,
            F.explode(F.sequence(F.col("k"), F.col("_next") - 1)).alias("k"),
            "_v.*",
        )

    def with_as_of(self, df: DataFrame) -> DataFrame:
        """Replace the slot number ``k`` by its decision time."""
        return df.join(self.schedule.select("as_of", "k"), "k").drop("k")
