"""Trading days: sessions numbered in order, so that day arithmetic is a look-up and a subtraction.

The calendar is a table with one row per day (a few ten thousand in a century). Every operation joins it
by equality on a day or on a session's number; nothing walks over dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.session import materialize


def weekdays(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day, session) of every day from first to last; Monday to Friday are sessions."""
    each = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return spark.range(1).select(each.alias("day")).withColumn("session", F.weekday("day") < 5)


def without(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """The days with the ``day`` rows of ``holidays`` closed."""
    closed = holidays.select("day").distinct().withColumn("_closed", F.lit(True))
    return days.join(closed, "day", "left").withColumn(
        "session", F.col("session") & F.col("_closed").isNull()
    ).drop("_closed")


class TradingCalendar:
    """Sessions of a table ``(day, session)`` that holds every day of its range once."""

    def __init__(self, days: DataFrame):
        year = F.year("day").alias("_year")
        counted = days.select("day", "session", F.col("session").cast("int").alias("_s"), year)
        # Years are counted apart and then added up.
        before = W.orderBy("_year").rowsBetween(W.unboundedPreceding, -1)
        offsets = counted.groupBy("_year").agg(F.sum("_s").alias("_t")).select(
            "_year", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o")
        )
        inside = W.partitionBy("_year").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
        self.days = materialize(
            counted.join(offsets, "_year")
            .select("day", "session", (F.col("_o") + F.sum("_s").over(inside)).alias("number")).coalesce(1)
        )
        self.sessions = self.days.where("session").select("number", "day")

    def numbered(self, df: DataFrame, day: str, out: str) -> DataFrame:
        """Add the number of sessions up to and on a day; null outside of the calendar."""
        look = self.days.select(F.col("day").alias(f"_{out}"), F.col("number").alias(out))
        return df.join(look, F.to_date(day) == F.col(f"_{out}"), "left").drop(f"_{out}")

    def add(self, df: DataFrame, day: str, n: int | str, out: str) -> DataFrame:
        """Add the n-th session after a day, before it if negative; 0 rolls forward to a session.

        ``n`` is a number or a column. Null where the calendar ends.
        """
        step = F.lit(n) if isinstance(n, int) else F.col(n)
        look = self.days.select(
            F.col("day").alias("_d"), F.col("session").alias("_s"), F.col("number").alias("_n")
        )
        upto = F.col("_n")
        here = F.col("_s").cast("int")
        target: Column = (
            F.when(step > 0, upto + step).when(step == 0, upto + 1 - here)
            .otherwise(upto - here + 1 + step)
        )
        at = self.sessions.select(F.col("number").alias("_at"), F.col("day").alias(out))
        return (
            df.join(look, F.to_date(day) == F.col("_d"), "left").withColumn("_to", target)
            .join(at, F.col("_to") == F.col("_at"), "left").drop("_d", "_s", "_n", "_to", "_at")
        )

    def between(self, df: DataFrame, start: str, end: str, out: str) -> DataFrame:
        """Add the number of sessions after ``start`` up to and on ``end``; negative if it is earlier."""
        df = self.numbered(self.numbered(df, start, "_from"), end, "_upto")
        return df.withColumn(out, F.col("_upto") - F.col("_from")).drop("_from", "_upto")


def previous(
    df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: str, out: str
) -> DataFrame:
    """Add the value of the row before, per key, computed in chunks of a long series.

    ``chunk`` never decreases along ``order``. Inside a chunk it is a lag; the first row of a chunk gets
    the last value of the chunk before, from a table with one row per chunk.
    """
    rows = df.withColumn("_c", chunk)
    last = rows.groupBy(*keys, "_c").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select(
        *keys, "_c", F.lag("_last").over(W.partitionBy(*keys).orderBy("_c")).alias("_carried")
    )
    inside = W.partitionBy(*keys, "_c").orderBy(*order)
    return (
        rows.join(carried, [*keys, "_c"])
        .withColumn(out, F.when(F.row_number().over(inside) == 1, F.col("_carried")).otherwise(
            F.lag(value).over(inside)
        ))
        .drop("_c", "_carried")
    )
