"""Landed files into the store: only new and changed files, a commit per group of files.

Every file has an entry (path, content hash, counts) in the store's table ``landed`` that appears with its
facts in one version. A run that stops half-way has committed whole groups; the next run takes the
rest. Rows that can't be read or fail an error-level quality check go to the table ``quarantine`` with a
reason and the line, so nothing disappears uncounted.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.operators import quality
from pitline.session import materialize
from pitline.sources import feeds
from pitline.sources.store import Store

#: Bytes and files of one commit, about.
GROUP_BYTES = 64 << 30
GROUP_FILES = 5_000


@dataclass
class Feed:
    """How the files of a feed are found and read.

    ``records`` turns ``(file, value)`` lines into rows with ``file``, ``line``, ``reason`` (null for a good
    row) and the record's columns; ``facts`` turns good records into facts and carries the columns it
    is told. ``checked`` are numbers that must be finite and positive.
    """

    pattern: str
    records: Callable[[DataFrame], DataFrame]
    facts: Callable[[DataFrame, list[str]], DataFrame]
    checked: tuple[str, ...] = ()


PRICES = Feed(
    "*.{csv,txt,CSV,TXT}", feeds.price_records, feeds.price_facts, ("close", "open", "high", "low")
)


def landed_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, file (its URI), length, sha256 of the files below a folder, hashed where they are read (up to 2 GB each)."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(folder)
    )
    return files.select(
        "path", F.col("_metadata.file_path").alias("file"), "length",
        F.sha2("content", 256).alias("sha256"),
    )


def outstanding(files: DataFrame, landed: DataFrame | None) -> DataFrame:
    """The files no version holds with this content; ``changed`` where it holds another content."""
    if landed is None:
        return files.withColumn("changed", F.lit(False))
    seen = landed.select("path", "sha256").distinct()
    paths = seen.select("path").distinct().withColumn("changed", F.lit(True))
    return (
        files.join(seen, ["path", "sha256"], "left_anti").join(paths, "path", "left")
        .withColumn("changed", F.coalesce("changed", F.lit(False)))
    )


def grouped(files: DataFrame, most: int = GROUP_FILES) -> tuple[DataFrame, int]:
    """Files with ``group`` (ranges of paths, so later paths are committed later) and ``seq``."""
    size = files.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    ).first()
    n = max(1, -(-size["n"] // most), -(-size["bytes"] // GROUP_BYTES))
    ranged = files.repartitionByRange(n, "path").withColumn("group", F.spark_partition_id())
    order = F.row_number().over(W.partitionBy("group").orderBy("path"))
    return materialize(ranged).withColumn("seq", order), n


def ingest_landed(
    store: Store, folder: str, feed: Feed = PRICES, commits: int | None = None,
    group_files: int = GROUP_FILES,
) -> DataFrame:
    """Take what has landed; one row of counts. ``commits`` ends the run after so many groups.

    ``n_added`` counts the facts the store didn't hold; copies of a fact in several files are settled by
    the last path.
    """
    spark = store.spark
    files = materialize(landed_files(spark, folder, feed.pattern))
    todo, n = grouped(outstanding(files, store.table("landed")), group_files)
    todo = materialize(todo)
    before = store.snapshot()["version"]
    added = done = 0
    for group in range(n):
        here = todo.where(F.col("group") == group)
        paths = [r["path"] for r in here.select("path").collect()]  # at most a group's files
        if not paths:
            continue
        if commits is not None and done == commits:
            break
        added += _take(store, here, paths, feed)["added"]
        done += 1
    landed = store.table("landed")
    counted = spark.createDataFrame(
        [], "path string, version long, changed boolean, n_rows long, n_facts long, n_rejected long"
    ) if landed is None else landed.where(F.col("version") > before)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counted.agg(
        F.lit(files.count()).cast("long").alias("files_seen"),
        F.count(F.lit(1)).alias("files_taken"),
        F.count(F.when(F.col("changed"), 1)).alias("files_changed"),
        total("n_rows").alias("n_rows"), total("n_facts").alias("n_facts"),
        total("n_rejected").alias("n_rejected"), F.lit(added).cast("long").alias("n_added"),
    )


def _take(store: Store, here: DataFrame, paths: list[str], feed: Feed) -> dict:
    """One group of files as one version."""
    spark = store.spark
    lines = spark.read.text([_literal(p) for p in paths]).select(
        F.col("_metadata.file_path").alias("file"), "value"
    )
    records = materialize(
        feed.records(lines)
        .withColumn("reason", F.coalesce("reason", quality.failed_check(feed.checked)))
        .join(here.select("file", "seq"), "file")
    )
    good = F.col("reason").isNull()
    counts = records.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(good, 1)).alias("n_facts"),
        F.count(F.when(~good, 1)).alias("n_rejected"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    entries = here.join(counts, "file", "left").select(
        "path", "sha256", "length", "changed", *(zero(c) for c in ("n_rows", "n_facts", "n_rejected")),
        F.lit(store.snapshot()["version"] + 1).cast("long").alias("version"),
    )
    facts = feed.facts(records.where(good).drop("reason", "line", "file"), ["seq"])
    rejected = records.where(~good).select("file", "reason", "line")
    return store.commit(facts, "seq", tables={"landed": entries, "quarantine": rejected})


def _literal(path: str) -> str:
    """The path with the signs escaped that readers take for patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
