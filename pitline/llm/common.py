"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a Python task, which bounds its memory besides single long texts.
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two columns the operators need; a null text counts as an empty one."""
    return id_and_text(table(spark, sf_dir, "documents"))


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


ARROW = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(columns: str) -> pa.Schema:
    """The Arrow schema of ``"name type, name type"``, usable inside tasks."""
    pairs = (c.split() for c in columns.split(","))
    return pa.schema([(name, ARROW[kind]) for name, kind in pairs])


def map_columns(df: DataFrame, make: Callable[[], Callable[..., dict]], schema: str) -> DataFrame:
    """Run Python over small batches of ``df``.

    ``make()`` runs once per task and returns a function from the columns (lists, in order) to a
    dict of output columns. Output batches are small too, so a task holds few texts at a time.
    """

    def run(batches):
        arrow = arrow_schema(schema)
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                got = work(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[f.name], f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)


def scaled_floors(vector: str, scale: int) -> Column:
    """floor(scale * x) / scale of every component as a double, exact for a power of two."""
    return F.transform(
        F.transform(vector, lambda x: x.cast("double")),
        lambda x: F.when(  # a double from 2^52 on is an integer already
            F.abs(x) < float(1 << 52), F.floor(x * float(scale)).cast("double") / float(scale)
        ).otherwise(x),
    )


def integers(values, scale: int) -> np.ndarray:
    """``scale`` times ``scaled_floors``: 64-bit integers below 2^40 * scale, Python's beyond."""
    values = np.asarray(values, dtype=float)
    if not values.size or np.abs(values).max() < 1 << 40:
        return (values * scale).astype(np.int64)
    exact = [int(x * scale) if abs(x) < 1e300 else int(x) * scale for x in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """The rows whose embedding isn't null or empty and has finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.where((F.size("embedding") > 0) & F.forall("embedding", finite))


def flat(parts) -> list:
    return list(itertools.chain.from_iterable(parts))


def settled(df: DataFrame) -> DataFrame:
    """``materialize``, after which Spark may delete the shuffle files that made the table.

    They are often several times the table's size; without them a later step has the disk.
    """
    from pitline.session import materialize

    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialize(df)
    finally:
        conf.set(key, before)


#: Keys with more than one in this many of all rows are hot; there can't be more hot keys than this.
HOT_KEYS = 10_000


def join_counted(rows: DataFrame, totals: DataFrame, keys: list[str], size: str, n: int) -> DataFrame:
    """Join the one row per key of ``totals`` to the ``n`` rows, whatever the share of one key.

    ``size`` is the column of ``totals`` with the number of rows of a key. Totals of hot keys, at most
    ``HOT_KEYS`` rows by their definition, are broadcast, so their rows stay where they are; the rows
    of all other keys are shuffled, and none of those keys has more than a ``HOT_KEYS``th of them. Keys
    are not null.
    """
    is_hot = F.col(size) > n / HOT_KEYS
    hot, cold = totals.where(is_hot), totals.where(~is_hot)
    left = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(left.join(cold, keys))
