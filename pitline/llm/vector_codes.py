"""Compressed vector codes (product quantisation) by integer k-means over value dictionaries.

Components become the integers floor(1024 * x). A vector is cut into consecutive parts, and each part
gets the index of the nearest of up to 256 entries of the codebook of its position. Blocks of rows
are written once in dictionary form: per dimension the distinct integers of the block, and per row
their numbers. In each round a task tabulates, per dimension, the squared differences of every distinct
integer to all entries; the distances of the parts are then gathers from these tables and additions.
Tasks send sums per entry, which Spark adds; the driver holds the codebooks only.

All arithmetic is exact: 32 or 64 bits where the block's largest difference allows it, Python
integers beyond; sums travel in limbs of 40 bits. An error that doesn't fit a long is null.

Vectors that are null, empty, or hold null or non-finite components are dropped. The codebook starts from
the rows with the smallest ids (null last, repeated ids in the order of their vectors); with fewer
rows than entries it has one entry per row. Vectors of another length than the row with the smallest
id have a null code and error. Parts differ by one component where their number doesn't divide the
length. Repeated rows count as often as they are there. Nothing but vec_id, embedding and label is
read; an empty table has no codes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.llm.common import integers, join_counted, scaled_floors, settled, usable_vectors

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows of a block; numbers of a dictionary then fit 16 bits.
BLOCK = 4096
LIMB = 40
LONGEST = (1 << 63) - 1
CODED = "vec_id long, label string, code string, error long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label as text, v: floor(SCALE * x) / SCALE per component, exact in a double."""
    return usable_vectors(vectors).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        scaled_floors("embedding", SCALE).alias("v"),
    )


def cuts(width: int) -> list[slice]:
    """The consecutive parts of a vector."""
    ends = [width * (i + 1) // PARTS for i in range(PARTS)]
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


def encode(rows: DataFrame) -> DataFrame:
    """Blocks of rows in dictionary form: ids, labels, per dimension distinct values and numbers."""
    schema = pa.schema([
        ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())),
        ("values", pa.list_(pa.list_(pa.float64()))), ("numbers", pa.binary()),
    ])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, labels, v = (c for c in batch.slice(at, BLOCK).columns)
                x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                found = [np.unique(column, return_inverse=True) for column in x.T]
                numbers = np.stack([n.ravel() for _, n in found]).astype(np.uint16)
                got = [ids.to_pylist()], [labels.to_pylist()], [[u.tolist() for u, _ in found]], [numbers.tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(got, schema)], schema=schema
                )

    return rows.mapInArrow(
        run, "ids array<long>, labels array<string>, values array<array<double>>, numbers binary"
    )


class Block:
    """A block of vectors in dictionary form."""

    def __init__(self, n: int, values: list, numbers: bytes):
        self.n = n
        self.values = [integers(u, SCALE) for u in values]
        self.numbers = np.frombuffer(numbers, dtype=np.uint16).reshape(len(values), n)

    def part(self, dims: range) -> np.ndarray:
        """The integers of one part of every vector."""
        return np.stack([self.values[d][self.numbers[d]] for d in dims], axis=1)

    def nearest(self, dims: range, codebook: list[list[int]]):
        """(index of the nearest entry, squared distance) of one part of every vector."""
        if not len(dims):  # more parts than components
            return np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        entries = np.array(codebook, dtype=object).T
        ends = [int(f(self.values[d])) for d in dims for f in (min, max)]
        bound = len(dims) * (max(*map(abs, ends), *map(abs, entries.ravel())) * 2) ** 2
        kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
        total = np.zeros((self.n, entries.shape[1]), dtype=kind)
        for d, entry in zip(dims, entries):
            table = (self.values[d].astype(kind)[:, None] - entry.astype(kind)[None, :]) ** 2
            total += table[self.numbers[d]]
        index = total.argmin(axis=1)
        return index, total[np.arange(self.n), index]


def _blocks(batches):
    for batch in batches:
        for ids, labels, values, numbers in zip(*(batch.column(i) for i in range(4))):
            ids = ids.as_py()
            yield ids, labels.as_py(), Block(len(ids), values.as_py(), numbers.as_py())


def _limbs(value: int):
    sign, value = (-1, -value) if value < 0 else (1, value)
    limb = 0
    while value:
        yield limb, sign * (value & ((1 << LIMB) - 1))
        value, limb = value >> LIMB, limb + 1


def _summed(parts: list[slice], codebooks: list):
    """Per task: the rows of each entry and the sums of their components (position -1: the number)."""
    schema = pa.schema([(n, pa.int32()) for n in ("part", "entry", "position", "limb")] + [("s", pa.int64())])

    def run(batches):
        sums: dict = {}
        for _, _, block in _blocks(batches):
            for p, cut in enumerate(parts):
                dims = range(cut.start, cut.stop)
                index, _ = block.nearest(dims, codebooks[p])
                order = np.argsort(index, kind="stable")
                used, start = np.unique(index[order], return_index=True)
                counts = np.diff([*start, len(order)])
                added = np.add.reduceat(block.part(dims)[order], start, axis=0) if dims else [[]] * len(used)
                for entry, n, s in zip(used.tolist(), counts.tolist(), added):
                    had = sums.setdefault((p, entry), [0] * (len(dims) + 1))
                    for i, x in enumerate([n, *map(int, s)]):
                        had[i] += x
        rows = [
            (p, entry, i - 1, limb, s) for (p, entry), had in sums.items()
            for i, x in enumerate(had) for limb, s in _limbs(x)
        ]
        columns = list(zip(*rows)) or [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _round(blocks: DataFrame, parts: list[slice], codebooks: list) -> list:
    """The codebooks after one more round; entries without parts stay."""
    schema = "part int, entry int, position int, limb int, s long"
    sent = blocks.mapInArrow(_summed(parts, codebooks), schema)
    sums: dict = {}
    for row in sent.groupBy("part", "entry", "position", "limb").agg(F.sum("s").alias("s")).collect():
        at = sums.setdefault((row["part"], row["entry"]), {})
        at[row["position"]] = at.get(row["position"], 0) + (row["s"] << LIMB * row["limb"])
    return [
        [
            [got.get(i, 0) // got[-1] for i in range(len(entry))] if (got := sums.get((p, e))) else entry
            for e, entry in enumerate(book)
        ]
        for p, book in enumerate(codebooks)
    ]


def _coded(parts: list[slice], codebooks: list):
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches):
        for ids, labels, block in _blocks(batches):
            found = [block.nearest(range(c.start, c.stop), b) for c, b in zip(parts, codebooks)]
            codes = ["".join(f"{i:02x}" for i in row) for row in zip(*(i.tolist() for i, _ in found))]
            errors = [sum(row) for row in zip(*(e.tolist() for _, e in found))]
            errors = [e if e <= LONGEST else None for e in errors]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip((ids, labels, codes, errors), schema)], schema=schema
            )

    return run


def learn(rows: DataFrame, blocks: DataFrame, first: list, rounds: int = ROUNDS):
    """(parts, codebooks): the entries start as the parts of the first vectors."""
    parts = cuts(len(first[0]))
    start = integers(first, SCALE).tolist()
    codebooks = [[v[cut] for v in start] for cut in parts]
    for _ in range(rounds):
        codebooks = _round(blocks, parts, codebooks)
    return parts, codebooks


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector."""
    spark = vectors.sparkSession
    rows = settled(usable(vectors))
    first = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()]
    if not first:
        return spark.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        )
    width = len(first[0])
    fits = F.size("v") == width
    blocks = settled(encode(rows.where(fits)))
    parts, codebooks = learn(rows, blocks, [v for v in first if len(v) == width])
    digest = hashlib.sha256(
        ",".join(str(x) for book in codebooks for entry in book for x in entry).encode()
    ).hexdigest()
    none = F.lit(None).cast("string")
    coded = settled(
        blocks.mapInArrow(_coded(parts, codebooks), CODED).unionByName(
            rows.where(~fits).select(
                "vec_id", "label", none.alias("code"), none.cast("long").alias("error")
            )
        ).select("vec_id", "code", "error", F.coalesce("label", F.lit("")).alias("key"),
                 F.col("label").isNull().alias("no_label"))
    )
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = settled(
        coded.groupBy("key", "no_label").agg(
            F.count(F.lit(1)).alias("rows"),
            F.when(total <= LONGEST, total).cast("long").alias("label_error"),
        )
    )
    return join_counted(coded, labels, ["key", "no_label"], "rows", coded.count()).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
