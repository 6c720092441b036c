"""Exact duplicates: groups of equal content hash, confirmed byte by byte.

Texts are equal when they are identical after lower-casing A-Z alone. Of equal texts the row with the
largest id stays. Everything is DataFrame functions:

1. The distinct pairs of 128-bit hash and text are formed by grouping on both. That compares the bytes
   of all texts with one hash, and copies inside a task are combined before they move, so a text that
   a third of all rows share moves once per task. Each distinct text gets its SHA-256.
2. What tells all those texts apart is chosen as the label of a group: the hash where no two texts
   share one, else hash and SHA-256, else hash and the text itself. As every distinct text has been
   seen, equal labels then mean equal bytes, not only probably.
3. Rows of (id, label) are counted per label; size and surviving id are joined back. Labels of more
   than a ten-thousandth of the rows are broadcast, at most ten thousand of them.

A null text counts as empty, and empty texts are equal to each other. A null id is smaller than any
other. Where rows repeat both id and text, exactly one of them is kept. Other columns of the documents
play no part, whatever their names. An empty table has no groups.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitline.llm.common import id_and_text, join_counted, settled

#: What may label a group, shortest first.
LABELS = (["hash"], ["hash", "text_sha256"], ["hash", "norm"])


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def normalised(docs: DataFrame, content_hash: Callable[[Column], Column]) -> DataFrame:
    """doc_id, norm (the text with A-Z in lower case), hash."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return id_and_text(docs).select("doc_id", low.alias("norm")).withColumn(
        "hash", content_hash(F.col("norm"))
    )


def telling_label(texts: DataFrame) -> list[str]:
    """The shortest label that no two different texts share, from all pairs of hash and text."""
    named = (
        texts.select("hash", "norm").distinct()
        .select("hash", F.sha2("norm", 256).alias("text_sha256"))
        .groupBy("hash", "text_sha256").agg(F.count(F.lit(1)).alias("texts"))
    )
    most = named.groupBy("hash").agg(
        F.sum("texts").alias("by_hash"), F.max("texts").alias("by_both")
    ).agg(F.max("by_hash").alias("by_hash"), F.max("by_both").alias("by_both")).first()
    if (most["by_hash"] or 1) == 1:
        return LABELS[0]
    return LABELS[1] if most["by_both"] == 1 else LABELS[2]


def exact_duplicates(
    docs: DataFrame, content_hash: Callable[[Column], Column] = hash128
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the id of the row that stays, text_sha256 that of the text as compared.
    """
    texts = normalised(docs, content_hash)
    label = telling_label(texts)
    rows = settled(
        texts.select(
            "doc_id", F.monotonically_increasing_id().alias("row"),
            F.sha2("norm", 256).alias("text_sha256"), *(c for c in label if c != "text_sha256"),
        )
    )
    groups = settled(
        rows.groupBy(*label).agg(
            F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top")
        )
    )
    joined = join_counted(rows, groups, label, "group_size", rows.count())
    return joined.select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256",
    )
