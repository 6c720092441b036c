"""Near-duplicate groups by SimHash, found by a binary trie joined with itself.

Every document gets a 64-bit fingerprint of its 4-word shingles; documents link when their
fingerprints differ in ``RADIUS`` bits or fewer. Distinct fingerprints form binary tries. A trie is
joined with itself by walking pairs of its nodes together: a pair whose bits differ spends one of
the allowed errors, a pair without budget is pruned.

To share the work out, the bits are cut into blocks. Two fingerprints with at most RADIUS errors
agree on all but RADIUS of the blocks, so for every choice of agreeing blocks there is one family of
tries, whose first levels are exactly these blocks: there only equal nodes pair up, and each such
node is a key Spark partitions by. The walk then goes on below. The number of blocks follows from the
number of fingerprints, so that a key holds few of them. A key that holds many is cut into pieces,
and each pair of pieces is walked on its own. Of the links found in a walk only a spanning forest
leaves the task, which keeps the components and is never larger than the walk's input.

Null or empty text: fingerprint zero, linked like any other. Repeated rows give a row each. A row
with a null id is never the smallest of its component; a component of such rows alone has a null id.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.llm.common import id_and_text, map_columns
from pitline.llm.components import connected, join_spread
from pitline.session import materialize

WORDS = 4
SEED = 42
RADIUS = 4
BITS = 64
#: Fingerprints of one key that are walked together, and fingerprints a task holds while walking.
PIECE = 1024
HELD = 65_536
#: Node pairs walked at once at most, as far as pieces allow.
PAIRS = 1 << 20


def fingerprint(text: str) -> int:
    """A bit is set if it is set in over half of the shingles' hashes, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(WORDS, len(words)) - 1 :].tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 8192):
        part = zip(starts[at : at + 8192], stops[at : at + 8192], strict=True)
        h = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in part], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), the fingerprint as a signed long."""

    def make():
        def work(ids, texts):
            return {"doc_id": ids, "fp": [_signed(fingerprint(t)) for t in texts]}

        return work

    return map_columns(id_and_text(docs), make, "doc_id long, fp long")


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the block choices; each keeps enough bits to tell ``n`` fingerprints apart."""
    wanted = math.log2(max(2, n)) + 2
    blocks = next(
        m for m in range(radius + 1, 2 * radius + 5)
        if (m - radius) * (BITS // m) >= wanted or m == 2 * radius + 4
    )
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(each, blocks - radius)]


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def walk(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS):
    """Index pairs within ``radius`` bits of each other, inside groups.

    ``fp`` (unsigned) is sorted within runs of equal ``group``: a run is an implicit binary trie, its
    nodes are ranges that share leading bits.
    """
    edges = np.flatnonzero(np.diff(group)) + 1
    lo = np.concatenate([[0], edges])
    hi = np.concatenate([edges, [len(group)]])
    many = hi - lo > 1
    a0, a1 = lo[many].astype(np.int32), hi[many].astype(np.int32)
    b0, b1, err = a0.copy(), a1.copy(), np.zeros(len(a0), dtype=np.int8)
    out_x, out_y = [], []
    for level in range(BITS - 1, -1, -1):
        if not len(a0):
            break
        ones = np.zeros(len(fp) + 1, dtype=np.int32)
        np.cumsum((fp >> np.uint64(level)) & np.uint64(1), out=ones[1:], dtype=np.int32)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        self_pair = a0 == b0
        parts = []
        for xs, xe, ys, ye, cost, keep in (
            (a0, am, b0, bm, 0, None),
            (am, a1, bm, b1, 0, None),
            (a0, am, bm, b1, 1, None),
            (am, a1, b0, bm, 1, ~self_pair),  # mirrored for a node with itself
        ):
            ok = (xe > xs) & (ye > ys) & (err + cost <= radius)
            ok &= (ys != xs) | (xe - xs > 1)
            if keep is not None:
                ok &= keep
            parts.append((xs[ok], xe[ok], ys[ok], ye[ok], (err[ok] + cost).astype(np.int8)))
        a0, a1, b0, b1, err = (np.concatenate(p) for p in zip(*parts, strict=True))
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            x, y = a0[leaf], b0[leaf]
            near = popcount(fp[x] ^ fp[y]) <= radius
            out_x.append(x[near])
            out_y.append(y[near])
            a0, a1, b0, b1, err = (v[~leaf] for v in (a0, a1, b0, b1, err))
    empty = np.zeros(0, dtype=np.int32)
    return np.concatenate([empty, *out_x]), np.concatenate([empty, *out_y])


def forest(n: int, x: np.ndarray, y: np.ndarray):
    """(node, root) for the nodes that aren't the smallest of their component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = new


def _links_of(keys: list[np.ndarray], fps: np.ndarray):
    """The spanning links of some whole groups; ``keys`` are the columns that make a group."""
    u = fps.view(np.uint64)
    order = np.lexsort((u, *keys))
    u = u[order]
    change = np.zeros(len(u), dtype=bool)
    for k in keys:
        k = k[order]
        change[1:] |= k[1:] != k[:-1]
    group = np.cumsum(change)
    first = np.concatenate([[True], (u[1:] != u[:-1]) | change[1:]])
    u, group = u[first], group[first]
    sizes = np.bincount(group).astype(np.int64)
    part = np.cumsum(sizes * sizes) // PAIRS  # groups walked together
    of = part[group]
    for p in np.unique(part[sizes > 1]):
        a, b = np.searchsorted(of, p), np.searchsorted(of, p, "right")
        x, y = walk(u[a:b], group[a:b])
        if len(x):
            node, root = forest(b - a, x, y)
            yield u[a:b][node].view(np.int64), u[a:b][root].view(np.int64)


def _walked(batches):
    """Rows (mask, k, i, j, fp) sorted by all but fp: hold whole groups, walk them, emit links."""
    held: list[np.ndarray] = []
    count = 0

    def emit(table):
        for a, b in _links_of(list(table[:4]), table[4]):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        count += batch.num_rows
        if count < HELD:
            continue
        rows = np.concatenate(held, axis=1)
        new = (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)
        cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0  # the last group may go on
        if cut:
            yield from emit(np.ascontiguousarray(rows[:, :cut]))
        held, count = [rows[:, cut:]], rows.shape[1] - cut
    if count:
        yield from emit(np.ascontiguousarray(np.concatenate(held, axis=1)))


def links(distinct: DataFrame, n: int, piece: int = PIECE) -> DataFrame:
    """Links (a, b) that connect all fingerprints (fp, distinct) within the radius."""
    rows = distinct.select(
        F.explode(F.array(*(F.lit(_signed(m)) for m in masks(n)))).alias("mask"), "fp"
    ).withColumn("k", F.col("fp").bitwiseAND(F.col("mask")))
    large = (
        rows.groupBy("mask", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece)
        .select("mask", "k", F.ceil(F.col("n") / piece).cast("long").alias("pieces"))
    )
    cut = rows.join(large, ["mask", "k"], "left").withColumn(
        "own", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("fp"), F.col("pieces"))).otherwise(0)
    )
    other = F.explode(F.expr("sequence(0L, coalesce(pieces, 1L) - 1L)"))
    pairs = cut.withColumn("other", other).select(
        "mask", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )
    keys = ["mask", "k", "i", "j"]
    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_walked, "a long, b long")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), one row per document."""
    rows = materialize(fingerprints(docs))
    distinct = materialize(
        rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    )
    found = links(distinct.select("fp"), distinct.count())
    stars = connected(found)
    labelled = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", "n", F.coalesce("component", "fp").alias("component")
    )
    sizes = labelled.groupBy("component").agg(
        F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")
    )
    labelled = materialize(labelled.withColumnRenamed("n", "rows"))
    of = join_spread(labelled, materialize(sizes), "component", labelled.count())
    return join_spread(
        rows, materialize(of.select("fp", "component_id", F.col("rows").alias("n"))), "fp", rows.count()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, one row per document."""
    return grouped(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Rows that repeat an id are told apart by all their columns; equal rows are one document.
    """
    content = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.withColumn("_llm_content", content)
    rows = materialize(
        map_columns(
            keyed.select(
                F.col("doc_id").cast("long"), "_llm_content",
                F.coalesce(F.col("text").cast("string"), F.lit("")),
            ),
            _keyed_fingerprints,
            "doc_id long, content long, fp long",
        )
    )
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content"))
    distinct = materialize(rows.groupBy("fp").agg(best.alias("first")))
    stars = connected(links(distinct.select("fp"), distinct.count()))
    kept = (
        distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left")
        .groupBy(F.coalesce("component", "fp").alias("c"))
        .agg(F.min("first").alias("first"))
        .select(
            F.col("first.doc_id").alias("_llm_id"), F.col("first.content").alias("_llm_kept")
        )
    )
    same = (F.col("_llm_content") == F.col("_llm_kept")) & F.col("doc_id").cast("long").eqNullSafe(
        F.col("_llm_id")
    )
    once = W.partitionBy("_llm_content", "doc_id").orderBy("_llm_content")
    return (
        keyed.join(kept, same, "left_semi")
        .withColumn("_llm_n", F.row_number().over(once)).where("_llm_n = 1")
        .drop("_llm_content", "_llm_n")
    )


def _keyed_fingerprints():
    def work(ids, contents, texts):
        return {
            "doc_id": ids, "content": contents, "fp": [_signed(fingerprint(t)) for t in texts]
        }

    return work
