"""The prefix trie of conversations, its subtree totals by time-forward processing.

``rebuild`` makes the conversations whose first turns may come from another one, ``prefixes`` names the
node of each of their prefixes, ``trie`` returns one row per node.

**Nodes.** A prefix is named by its depth and running sums of hashes of (depth, turn). All prefixes that
share a name must agree on their last turn (SHA-256 of role and text) and on the name of their
parent, which by induction proves them equal; if any don't, other hashes are taken. A node is known by
its smallest member and its depth.

**Totals.** A node's weight, the turns of its members from it on, never grows downwards. Its tier is how
often ``SHARE`` goes into the weight; connected nodes of one tier form a shard, so a shard of the lowest
tier has less than ``SHARE`` nodes, and a higher one less than that per level. Tier by tier, Spark
sorts the nodes of the shards by reverse level order, and tasks pass children, leaves and saved
tokens from each node to its parent through a priority queue that spills to sorted runs. What the
roots of shards have is summed per parent and passed to the next tier.

Null roles and texts are empty; rows without conv_id belong to no conversation. Turns are in order of
their number, null first, equal ones in order of the SHA-256 of role and text, repeated rows
counting as often as they are there. Nothing but conv_id, turn, role and text is read. No conversations
make no trie, not even a root.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import struct
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.crosssection import running_total
from pitline.llm.common import ROWS, arrow_schema, join_counted, settled

#: A conversation starts like the first one of its block of so many ids, for less than HEADS turns.
BLOCK, HEADS = 100, 6
#: Weight of a shard of the lowest tier, and factor from tier to tier.
SHARE = 256
TIERS = 7
#: Hash words of a prefix name; turns of a piece of running sums.
WORDS = ["k1", "k2", "k3", "k4"]
PIECE = 1024
#: Messages a queue holds before it spills; sorted runs before they are merged.
HELD, RUNS = 200_000, 16
#: Ids of a piece of an end list.
IDS = 4096

WALKED = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, root boolean"
)


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), sha, n_chars of every turn.

    Turns are numbered inside sampled ranges and shifted by the ranges before, so that one long
    conversation is spread over tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.sha2(told, 256)).alias("sha"), F.length(text).cast("long").alias("n_chars"),
    )
    order = [F.asc_nulls_first("turn"), F.col("sha")]
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = settled(
        turns.repartitionByRange(tasks, "conv_id", *order)
        .withColumn("range", F.spark_partition_id())
    )
    before = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    shifts = ranges.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")
    )
    inside = F.row_number().over(W.partitionBy("conv_id", "range").orderBy(*order))
    return ranges.join(shifts, ["conv_id", "range"]).select(
        "conv_id", (inside + F.col("shift")).alias("pos"), "sha", "n_chars"
    )


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, sha, n_chars, length of the rebuilt turns; conv_id, length of all)."""
    turns = settled(numbered(conversations))
    counts = settled(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")))
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    taken = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("long")
    of_head = counts.select(F.col("conv_id").alias("block"), F.col("turns").alias("there"))
    borrowed = F.least("taken", F.coalesce("there", F.lit(0)))
    own = F.greatest(F.col("turns") - F.col("taken"), F.lit(0))
    convs = settled(
        counts.withColumns({"block": block, "taken": taken})
        .join(of_head, "block", "left")
        .select("conv_id", "block", "turns", "taken", borrowed.alias("borrowed"),
                (borrowed + own).alias("length"))
    )
    heads = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < HEADS)).select(
        F.col("conv_id").alias("block"), F.col("pos").alias("depth"), "sha", "n_chars"
    )
    columns = ["conv_id", "depth", "sha", "n_chars", "length"]
    first = convs.join(heads, "block").where(F.col("depth") <= F.col("borrowed")).select(*columns)
    rest = join_counted(turns, convs, ["conv_id"], "turns", turns.count()).where(
        F.col("pos") > F.col("taken")
    ).withColumn("depth", F.col("pos") - F.col("taken") + F.col("borrowed")).select(*columns)
    return first.unionByName(rest), convs.select("conv_id", "length")


def prefixes(turns: DataFrame, seed: int = 0, bits: int = 32) -> DataFrame:
    """The turns with the words of the prefix they end, and of their own hash (``w1`` ...)."""
    word = {
        w: F.shiftrightunsigned(F.xxhash64(F.lit(seed * len(WORDS) + i), "depth", "sha"), 64 - bits)
        for i, w in enumerate(WORDS)
    }
    own = {f"w{i + 1}": c for i, c in enumerate(word.values())}
    pieces = turns.withColumns({"piece": F.floor(F.col("depth") / PIECE), **own})
    sums = {w: F.col(o) for w, o in zip(WORDS, own)}
    return running_total(pieces, ["conv_id"], "piece", ["depth"], sums)


def name_nodes(turns: DataFrame, bits: int = 32) -> tuple[DataFrame, DataFrame]:
    """(prefixes, nodes): nodes have their smallest member ``rep``, n_convs, weight and n_chars."""
    turns = settled(turns)
    parent = F.struct(*(F.col(w) - F.col(f"w{i + 1}") for i, w in enumerate(WORDS)))
    same = lambda c: F.min(c) == F.max(c)
    for seed in itertools.count():
        rows = settled(prefixes(turns, seed, bits))
        nodes = settled(
            rows.groupBy("depth", *WORDS).agg(
                F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"),
                F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
                F.max("n_chars").alias("n_chars"), (same("sha") & same(parent)).alias("proven"),
            )
        )
        if not nodes.where("not proven").limit(1).count():
            return rows, nodes
        bits = min(32, bits * 2)


def tier(weight) -> F.Column:
    """How often SHARE goes into the weight."""
    return sum((weight >= SHARE**i).cast("int") for i in range(1, TIERS + 1))


class Messages:
    """A priority queue of (level order, children, leaves, saved) that spills to sorted runs.

    Runs are unnamed files of the task, gone with it. Messages for one parent are added up when
    they spill and when they are taken.
    """

    RECORD = struct.Struct("<5q")

    def __init__(self, held: int = HELD, runs: int = RUNS):
        self.held, self.most = held, runs
        self.heap: list = []
        self.runs: list = []  # [head, rest], sorted

    def push(self, order: tuple[int, int], children: int, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (order, children, leaves, saved))
        if len(self.heap) >= self.held:
            self._spill(self._added(sorted(self.heap)))
            self.heap = []
            if len(self.runs) > self.most:
                parts = [itertools.chain([head], rest) for head, rest in self.runs]
                self.runs = []
                self._spill(self._added(heapq.merge(*parts)))

    @staticmethod
    def _added(messages):
        for order, same in itertools.groupby(messages, key=lambda m: m[0]):
            totals = [sum(c) for c in list(zip(*same))[1:]]
            yield (order, *totals)

    def _spill(self, messages) -> None:
        file = tempfile.TemporaryFile()
        for (level, conv), *totals in messages:
            file.write(self.RECORD.pack(level, conv, *totals))
        file.seek(0)
        rest = self._read(file)
        self.runs.append([next(rest), rest])

    def _read(self, file):
        with file:
            while record := file.read(self.RECORD.size * ROWS):
                for level, conv, *totals in self.RECORD.iter_unpack(record):
                    yield ((level, conv), *totals)

    def pop(self, order: tuple[int, int]) -> tuple[int, int, int]:
        """The sums of all messages for one parent; parents are asked in rising order."""
        totals = [0, 0, 0]
        while self.heap and self.heap[0][0] == order:
            totals = [a + b for a, b in zip(totals, heapq.heappop(self.heap)[1:])]
        for run in self.runs:
            while run[0] is not None and run[0][0] == order:
                totals = [a + b for a, b in zip(totals, run[0][1:])]
                run[0] = next(run[1], None)
        self.runs = [run for run in self.runs if run[0] is not None]
        return tuple(totals)


def walk(held: int = HELD):
    """Nodes sorted by reverse level order -> nodes with the totals of their subtrees.

    Rows have the totals that came from other shards; the root of a shard sends to no one here.
    """

    def run(batches):
        schema = arrow_schema(WALKED)
        queue = Messages(held)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out = []
                for row in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns)):
                    conv, depth, parent, n, value, root, *came = row
                    totals = queue.pop((-depth, conv))
                    children, leaves, saved = (a + b for a, b in zip(came, totals))
                    leaves, saved = leaves if children else 1, saved + value
                    out.append((conv, depth, parent, n, children, leaves, saved, root))
                    if not root:
                        queue.push((1 - depth, parent), 1, leaves, saved)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema
                )

    return run


def subtree_totals(nodes: DataFrame, tiers: int, held: int = HELD) -> DataFrame:
    """Nodes with n_children, n_leaves and saved_tokens, shards of low tiers first.

    ``nodes``: conv_id, depth, parent_conv_id, n_convs, value, tier, shard_conv, shard_depth.
    """
    done: list[DataFrame] = []
    for level in range(tiers):
        here = nodes.where(F.col("tier") == level)
        came = {"came_children": "n", "came_leaves": "n_leaves", "came_saved": "saved_tokens"}
        if done:
            sent = done[0]
            for more in done[1:]:
                sent = sent.unionByName(more)
            sent = sent.where("root and depth > 0").withColumn("n", F.lit(1)).groupBy(
                F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")
            ).agg(*(F.sum(c).alias(n) for n, c in came.items()))
            here = here.join(sent, ["conv_id", "depth"], "left")
        else:
            here = here.withColumns({n: F.lit(None).cast("long") for n in came})
        root = (F.col("conv_id") == F.col("shard_conv")) & (F.col("depth") == F.col("shard_depth"))
        ordered = (
            here.repartition("shard_conv", "shard_depth")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "value", root.alias("root"),
                    *(F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in came))
            .sortWithinPartitions(F.desc("depth"), "conv_id")
        )
        done.append(settled(ordered.mapInArrow(walk(held), WALKED)))
    return _union(done)


def _union(frames: list[DataFrame]) -> DataFrame:
    all_of = frames[0]
    for more in frames[1:]:
        all_of = all_of.unionByName(more)
    return all_of


def _pieces(batches):
    """Sorted (conv_id, depth, end) -> (conv_id, depth, first end, ends comma-joined) in pieces."""
    schema = arrow_schema("conv_id long, depth long, first long, ends string")
    node, ends = None, []
    for batch in batches:
        out = []
        for conv, depth, end in zip(*(c.to_pylist() for c in batch.columns)):
            if ends and (node != (conv, depth) or len(ends) == IDS):
                out.append((*node, ends[0], ",".join(map(str, ends))))
                ends = []
            node = (conv, depth)
            ends.append(end)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if ends:
        last = [[*node, ends[0], ",".join(map(str, ends))]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), schema)], schema=schema)


def _digests(batches):
    """Sorted pieces -> (conv_id, depth, ends_sha256), a stream of constant memory."""
    schema = arrow_schema("conv_id long, depth long, ends_sha256 string")
    node, digest = None, None
    for batch in batches:
        out = []
        for conv, depth, _, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if node == (conv, depth):
                digest.update(b",")
            else:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (conv, depth), hashlib.sha256()
            digest.update(ends.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if node:
        last = [(*node, digest.hexdigest())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), schema)], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, from (conv_id, depth, end).

    A digest has to be made in order, so what a task streams for a node that many conversations end
    at are joined pieces of ids, made before in sampled ranges.
    """
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["conv_id", "depth"]
    pieces = (
        ends.select(*key, "end").repartitionByRange(tasks, *key, "end")
        .sortWithinPartitions(*key, "end")
        .mapInArrow(_pieces, "conv_id long, depth long, first long, ends string")
    )
    return (
        pieces.repartition(*key).sortWithinPartitions(*key, "first")
        .mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")
    )


def trie(conversations: DataFrame, held: int = HELD, bits: int = 32) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    turns, convs = rebuild(conversations)
    convs = settled(convs)
    top = convs.agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep"),
        F.sum(F.col("length") + 1).alias("weight"), F.sum("length").alias("turns"),
    ).first()
    spark = conversations.sparkSession
    if not top["n"]:
        return spark.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
            "n_leaves long, saved_tokens long, ends_sha256 string",
        )
    rows, nodes = name_nodes(turns, bits)
    nodes = nodes.select(
        "depth", *WORDS, "rep", "n_convs", tier(F.col("weight")).alias("tier"),
        ((F.col("n_convs") - 1) * F.col("n_chars")).alias("value"),
    )
    placed = settled(
        join_counted(
            rows.select("conv_id", "depth", *WORDS, "length"), nodes, ["depth", *WORDS], "n_convs",
            top["turns"],
        ).select("conv_id", F.col("depth").cast("long").alias("depth"), "length", "rep", "n_convs",
                 "value", "tier")
    )
    highest = sum(top["weight"] >= SHARE**i for i in range(1, TIERS + 1))

    # The first node of a conversation's path in each tier is the root of the shard there.
    tops = placed.groupBy("conv_id", "tier").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("depth", "rep")).alias("shard")
    ).withColumn(
        "shard", F.when(F.col("tier") == highest, F.struct(
            F.lit(0).cast("long").alias("depth"), F.lit(top["rep"]).alias("rep")
        )).otherwise(F.col("shard"))
    )
    own = placed.where(F.col("conv_id") == F.col("rep"))
    above = placed.select(
        "conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("parent_conv_id")
    )
    own = own.join(above, ["conv_id", "depth"], "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", F.lit(top["rep"]))
    )
    own = join_counted(own, tops, ["conv_id", "tier"], "size", top["turns"] or 0).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "value", "tier",
        F.col("shard.rep").alias("shard_conv"), F.col("shard.depth").alias("shard_depth"),
    )
    root = spark.createDataFrame(
        [(top["rep"], 0, None, top["n"], 0, highest, top["rep"], 0)],
        "conv_id long, depth long, parent_conv_id long, n_convs long, value long, tier int, "
        "shard_conv long, shard_depth long",
    )
    totals = subtree_totals(settled(own.unionByName(root)), highest + 1, held)
    ends = placed.where(F.col("depth") == F.col("length")).select(
        F.col("rep").alias("node"), "depth", F.col("conv_id").alias("end")
    ).unionByName(
        convs.where("length = 0").select(
            F.lit(top["rep"]).alias("node"), F.lit(0).cast("long").alias("depth"),
            F.col("conv_id").alias("end"),
        )
    ).withColumnRenamed("node", "conv_id")
    return totals.drop("root").join(end_digests(ends), ["conv_id", "depth"], "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    )
