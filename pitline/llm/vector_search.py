"""Exact nearest vectors by inner product with vector-approximation files.

Vectors are cut into blocks of bounded size, queries too; each pair of blocks is one unit of work.
Within it every vector has an approximation of ``CELL_BITS`` bits per component, the cell it lies in.
A scan of the cells alone bounds each score from both sides. The exact vectors are then read in the
order of the best bound until the kth score found can't be beaten by the next bound. Each unit
returns its best k per query, and Spark ranks those.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
an id. Rows that repeat an id and its vector count once; a query never meets its own id. Only vectors
of equal length are compared. Scores are exact: a block whose largest possible score doesn't fit 64
bits is computed in Python integers. A score that itself doesn't fit a long is null; it has its right
rank all the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.llm.common import integers, scaled_floors, usable_vectors
from pitline.session import materialize

SCALE = 64
K = 20
CELL_BITS = 4
#: Vectors of a block: a 64th of all within these bounds; queries of a block: a 16th.
BLOCK = (8192, 131_072)
QUERIES = (1024, 65_536)
#: Components beyond which doubles can't bound a score.
BOUNDED = 1e150
LONGEST = (1 << 63) - 1
LIMB = 62
#: Exact vectors read between two looks at the bounds.
READ = 64


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part; v is floor(SCALE * x) / SCALE."""
    return (
        usable_vectors(vectors).where(F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("long").alias("vec_id"), scaled_floors("embedding", SCALE).alias("v"))
        .distinct()
    )


def fitting(queries: np.ndarray, x: np.ndarray):
    """Both as 64-bit integers if every score surely fits one, else as Python integers."""
    largest = [max(abs(int(m.max())), abs(int(m.min()))) for m in (queries, x)]
    kind = np.int64 if largest[0] * largest[1] * x.shape[1] <= LONGEST else object
    return queries.astype(kind), x.astype(kind)


class ApproximationFile:
    """The cells of a block of integer vectors and what is needed to bound scores from them."""

    def __init__(self, x: np.ndarray):
        low = x.min(axis=0)
        self.bounded = max(abs(int(low.min())), abs(int(x.max()))) < BOUNDED
        if not self.bounded:
            self.n = len(x)
            return
        step = (x.max(axis=0) - low) // (1 << CELL_BITS) + 1
        self.cells = ((x - low) // step).astype(np.uint8)
        self.low, self.step = low.astype(float), step.astype(float)
        self.half = (self.step - 1) / 2

    def bounds(self, queries: np.ndarray):
        """Lower and upper bounds, queries by vectors: the middle of the cell and its half width."""
        if not self.bounded or max(abs(int(queries.max())), abs(int(queries.min()))) >= BOUNDED:
            none = np.full((len(queries), self.cells.shape[0] if self.bounded else self.n), np.inf)
            return -none, none
        q = queries.astype(float)
        middle = self.cells * self.step + (self.low + self.half)
        centre = q @ middle.T
        slack = np.abs(q) @ self.half
        slack += 1e-9 * (np.abs(q) @ (np.abs(self.low) + self.step * (1 << CELL_BITS))) + 1e-9
        return centre - slack[:, None], centre + slack[:, None]


def best(query, own, upper, lower, ids, x, k):
    """(ids, scores) of the k best of a block for one query, ties to smaller ids."""
    allowed = np.flatnonzero(ids != own)
    if not len(allowed):
        return ids[:0], np.zeros(0, dtype=np.int64)
    up, low = upper[allowed], lower[allowed]
    if len(allowed) > k:  # no vector below the kth best lower bound can be among the k
        sure = np.partition(low, len(low) - k)[len(low) - k]
        inside = up >= sure
        allowed, up = allowed[inside], up[inside]
    order = np.argsort(-up, kind="stable")
    allowed, up = allowed[order], up[order]
    got_ids, got = ids[:0], np.zeros(0, dtype=x.dtype)
    for at in range(0, len(allowed), READ):
        if len(got) >= k and got[-1] > up[at]:
            break
        rows = allowed[at : at + READ]
        got = np.concatenate([got, x[rows] @ query])
        got_ids = np.concatenate([got_ids, ids[rows]])
        if got.dtype == object:
            top = sorted(range(len(got)), key=lambda i: (-got[i], got_ids[i]))[:k]
        else:
            top = np.lexsort((got_ids, -got))[:k]
        got_ids, got = got_ids[top], got[top]
    return got_ids, got


def sortable(score: int):
    """(score or null, level, limbs): level, limbs and score are in the order of the scores."""
    if -LONGEST <= score <= LONGEST:
        return score, 0, []
    sign, rest, limbs = 1 if score > 0 else -1, abs(score), []
    while rest:
        limbs.append(sign * (rest & ((1 << LIMB) - 1)))
        rest >>= LIMB
    return None, sign * len(limbs), limbs[::-1]


FOUND = "query_id long, vec_id long, score long, level long, limbs array<long>"


def _unit(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        q_ids, q = _matrix(queries)
        ids, x = _matrix(vectors)
        out_q, out_v, out_s = [], [], []
        if len(q_ids) and len(ids):
            q, x = fitting(q, x)
            file = ApproximationFile(x)
            at_once = max(1, (1 << 21) // len(ids))
            for at in range(0, len(q_ids), at_once):
                lower, upper = file.bounds(q[at : at + at_once])
                for i in range(len(lower)):
                    own = q_ids[at + i]
                    v, s = best(q[at + i], own, upper[i], lower[i], ids, x, k)
                    out_q += [own] * len(v)
                    out_v += v.tolist()
                    out_s += s.tolist()
        scores = list(zip(*map(sortable, out_s))) or [[], [], []]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        names = [column.split()[0] for column in FOUND.split(", ")]
        columns = [pa.array(c, t) for c, t in zip((out_q, out_v, *scores), kinds)]
        return pa.table(dict(zip(names, columns)))

    return run


def _matrix(table: pa.Table):
    ids = table.column("vec_id").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, integers(flat.reshape(len(ids), -1), SCALE) if len(ids) else flat


def nearest(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each query.

    ``is_query`` is a condition on vec_id.
    """
    rows = materialize(integer_vectors(vectors))
    n = rows.agg(
        F.count(F.lit(1)).alias("all"), F.count(F.when(is_query, 1)).alias("asked")
    ).first()
    size = min(max(BLOCK[0], -(-n["all"] // 64)), BLOCK[1])
    few = min(max(QUERIES[0], -(-n["asked"] // 16)), QUERIES[1])
    blocks, asks = max(1, -(-n["all"] // size)), max(1, -(-n["asked"] // few))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    of = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    dim = F.size("v").alias("dim")
    left = rows.where(is_query).select("vec_id", "v", dim, of(asks).alias("qb"), every(blocks).alias("db"))
    right = rows.select("vec_id", "v", dim, every(asks).alias("qb"), of(blocks).alias("db"))
    unit = ["dim", "qb", "db"]
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(
        _unit(k), FOUND
    )
    order = W.partitionBy("query_id").orderBy(F.desc("level"), F.desc("limbs"), F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
