"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous sweeps.

Documents longer than a sequence are cut; the pieces then go, longest first, each into the sequence
with the smallest gap that holds it. Pieces of one length are equal to the packer, and so are
sequences with one gap. A sweep therefore works on runs: all pieces of a length against the gaps in
rising order (the successors of the length), each run of gaps taking as many pieces as fit. A piece's
rank among those of its length decides which sequence of the run it gets, so there are no conflicts;
the gaps are updated, and the next shorter length follows. The result is the one of placing the
pieces one by one.

There are at most ``LIMIT`` lengths and gaps whatever the input, so the sweeps need only the number of
pieces of each length. Ranks and places of the pieces are computed by Spark: a length is split into
shards by a hash, the shards are numbered one after the other, and each piece looks its place up in
the table of runs.

Null or empty text: one piece with the end token alone. Repeated rows are packed once each. A null id
stays null.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.llm.common import id_and_text, map_columns
from pitline.session import materialize

LIMIT = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces of a shard of one length, about.
SHARD = 500
#: Words whose ids a task remembers.
REMEMBERED = 600_000


class WordIds(dict):
    """Ids of words without white space as little-endian bytes, filled as words come up.

    The vocabulary drops white space and never merges across it, so the ids of a text are those of
    its words in a row.
    """

    def __init__(self, library, pattern: str):
        import regex

        super().__init__()
        self.model = library.model
        self.split = regex.compile(pattern).findall
        # Fixed table of byte-level vocabularies: printable bytes stand for themselves.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.char = {b: chr(b) if b in set(plain) else chr(next(other)) for b in range(256)}

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            ids = [t.id for t in self.model.tokenize(word)]
        else:
            ids = [
                t.id
                for part in self.split(word)
                for t in self.model.tokenize("".join(map(self.char.__getitem__, part.encode())))
            ]
        got = np.array(ids, dtype="<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = got
        return got


def encoder(vocabulary: str):
    """A function from a text to its ids as little-endian bytes."""
    import json
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(vocabulary)
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        words = WordIds(library, json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    beyond = re.compile("[^\x00-ɏ]")  # Latin texts are already in composed form
    special = [t.content for t in library.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        if beyond.search(text) or any(s in text for s in special):
            ids = library.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        return b"".join(map(words.__getitem__, text.lower().replace("\n", " ").split(" ")))

    return encode


def _pieces(vocabulary: str, limit: int, end: int):
    encode = encoder(vocabulary)
    last = np.array([end], dtype="<u4").tobytes()

    def work(ids, texts):
        out = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, text in zip(ids, texts, strict=True):
            data = encode(text) + last
            for k, at in enumerate(range(0, len(data), 4 * limit)):
                part = data[at : at + 4 * limit]
                for c, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[c].append(v)
        return out

    return work


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each document."""
    return map_columns(
        id_and_text(docs),
        lambda: _pieces(vocabulary, limit, end),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


class Runs:
    """Places of equal pieces: for each run its length, first rank, pieces per sequence, first
    sequence and the offset of the first piece there."""

    def __init__(self, counts: dict[int, int], limit: int):
        gaps: list[int] = []  # rising
        free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of sequences
        rows: list[tuple[int, int, int, int, int]] = []
        total = 0

        def leave(gap, first, n):
            if gap and n:
                if not free[gap]:
                    bisect.insort(gaps, gap)
                free[gap].append((first, n))

        for length in sorted(counts, reverse=True):
            left, rank = counts[length], 0
            k = bisect.bisect_left(gaps, length)
            changed = []
            while left:
                if k < len(gaps):
                    gap = gaps[k]
                    first, n = free[gap].pop()
                    if not free[gap]:
                        gaps.pop(k)  # the next gap moves up to k
                else:
                    gap, first, n = limit, total, -(-left // (limit // length))
                    total += n
                per = gap // length
                full, rest = divmod(min(left, n * per), per)
                if full:
                    rows.append((length, rank, per, first, limit - gap))
                    rank += full * per
                    changed.append((gap - per * length, first, full))
                if rest:
                    rows.append((length, rank, rest, first + full, limit - gap))
                    rank += rest
                    changed.append((gap - rest * length, first + full, 1))
                used = full + (rest > 0)
                left -= full * per + rest
                changed.append((gap, first + used, n - used))
            for run in changed:
                leave(*run)
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.rows = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.sequences = total
        self.rank_base = 1 << 48

    def places(self, length: np.ndarray, rank: np.ndarray):
        """(sequence_id, offset) of pieces by length and rank."""
        key = self.rows[:, 0] * self.rank_base + self.rows[:, 1]
        run = self.rows[np.searchsorted(key, length * self.rank_base + rank, "right") - 1]
        turn = rank - run[:, 1]
        return run[:, 3] + turn // run[:, 2], run[:, 4] + turn % run[:, 2] * length


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece."""
    rows = materialize(pieces(docs, vocabulary, limit, end))
    # One row per length, ``limit`` at most: small enough to collect and to broadcast.
    sizes = materialize(rows.groupBy("length").agg(F.count(F.lit(1)).alias("of_length")))
    runs = Runs({r["length"]: r["of_length"] for r in sizes.collect()}, limit)
    shards = F.ceil(F.col("of_length") / F.lit(SHARD))
    sharded = rows.join(F.broadcast(sizes), "length").withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), shards)
    )
    before = W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sharded.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    inside = W.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        sharded.withColumn("n", F.row_number().over(inside)).join(starts, ["length", "shard"])
        .withColumn("rank", F.col("before") + F.col("n") - 1)
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = runs.places(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    return ranked.select(*names, "rank").mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
