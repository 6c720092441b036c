"""Nearest resolved decisions against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitline.operators import recall

EPISODES = "key string, vector array<double>, outcome double, matured long, regime string"
QUERIES = "query string, vector array<double>, seen long, scale array<double>, regime string"


def brute(episodes, queries, k):
    out = []
    for name, q, seen, scale, regime in queries:
        near = sorted(
            (float(np.sqrt(sum(((a - b) / s) ** 2 for a, b, s in zip(v, q, scale)))), key)
            for key, v, _, at, r in episodes if at <= seen and (regime is None or r == regime)
        )[:k]
        out += [(name, i + 1, key) for i, (_, key) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("block, asked", [(8, 3), (64, 1000)])
def test_nearest_resolved_equals_brute_force(spark, block, asked):
    rng = np.random.default_rng(block)
    places = rng.normal(size=(6, 3)) * 10
    episodes = [
        (f"e{i:04}", (places[i % 6] + rng.normal(size=3)).round(2).tolist(), float(i), int(rng.integers(0, 9)),
         [None, "on", "off"][i % 3]) for i in range(700)
    ]
    episodes += [(f"t{i}", episodes[5][1], 1.0, 3, "on") for i in range(20)]  # ties
    queries = [
        (f"q{i}", (places[i % 6] + rng.normal(size=3)).tolist(), int(rng.integers(-1, 9)),
         rng.uniform(0.2, 5, size=3).tolist(), [None, "on", "off", "none such"][i % 4]) for i in range(60)
    ] + [("tie", episodes[5][1], 3, [1.0, 1.0, 1.0], "on")]
    got = recall.matured_nearest(
        spark.createDataFrame(episodes, EPISODES).repartition(3), spark.createDataFrame(queries, QUERIES), 7,
        ["regime"], block, asked,
    )
    assert sorted((r.query, r.rank, r.key) for r in got.collect()) == brute(episodes, queries, 7)


def test_far_blocks_are_not_visited(spark):
    rng = np.random.default_rng(1)
    rows = [(f"e{i:05}", (rng.normal(size=2) + 100 * (i % 8)).tolist(), 1.0, 1, "x") for i in range(4000)]
    known = spark.createDataFrame(rows, EPISODES)
    spread = recall._spread(known)
    pivots = recall._pivots(known, spread)
    _, blocks = recall._blocks(known, pivots, spread, [], 50)
    index = recall._Index(pivots, spread, blocks.toPandas(), [], 5)
    asked = spark.createDataFrame([(f"q{i}", rows[i][1], 1, [1.0, 1.0], "x", 3.0) for i in range(50)],
                                  QUERIES + ", bound double")
    assert blocks.count() >= 80
    visits = index.pairs(asked, False).unionByName(index.pairs(asked, True)).count()
    assert visits < 50 * blocks.count() / 4


def test_no_episodes(spark):
    none, one = spark.createDataFrame([], EPISODES), spark.createDataFrame([("q", [1.0], 1, [1.0], "x")], QUERIES)
    assert recall.matured_nearest(none, one).count() == 0


def test_scales_of_what_was_known(spark):
    journal = spark.createDataFrame([(1, 1.0, None), (1, 3.0, None), (3, 8.0, 2.0)], "matured long, a double, b double")
    schedule = spark.createDataFrame([(k,) for k in range(5)], "k long")
    got = {r.k: r.scale for r in recall.known_scales(journal, ["a", "b"], schedule).collect()}
    sd = [float(np.std([1, 3, 8])), float(np.std([0, 0, 2]))]
    assert got[0] == [1.0, 1.0] and got[1] == [1.0, 1.0] == got[2]
    assert got[3] == pytest.approx(sd) and got[4] == pytest.approx(sd)
