"""Vector codes, exact duplicates and the conversation trie against plain Python on odd tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitline.llm import (
    conversation_trie,
    exact_dedup,
    quality,
    substrings,
    toxicity,
    vector_codes,
    vector_search,
)


# --- op11 -------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, v string, part int, code string"


def brute_codes(rows, entries=256, rounds=4):
    """(vec_id, code, error, label) of usable vectors in Python integers, and the codebooks."""
    kept = [
        (i, [int(math.floor(x * 1024)) if abs(x) < 1e300 else int(x) * 1024 for x in v], label)
        for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    ends = [width * k // 4 for k in range(5)]
    cut = lambda v, p: v[ends[p] : ends[p + 1]]
    start = [v for _, v, _ in kept[:entries] if len(v) == width]
    books = [[cut(v, p) for v in start] for p in range(4)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups = defaultdict(list)
            for _, v, _ in kept:
                if len(v) == width:
                    groups[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            for i, members in groups.items():
                books[p][i] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, v, label in kept:
        if len(v) != width:
            out.append((i, None, None, label))
            continue
        found = [nearest(cut(v, p), books[p]) for p in range(4)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{e:02x}" for _, e in found), error if error < 1 << 63 else None, label))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return out, hashlib.sha256(text.encode()).hexdigest()


def odd_vectors(n, scale, width=6, seed=1):
    random.seed(seed)
    rows = [
        (i, [random.choice([-1, 1]) * random.random() * scale for _ in range(width)], random.choice([None, 1, 2]))
        for i in range(n)
    ]
    return rows + [
        (n, None, 1), (n + 1, [], 1), (n + 2, [1.0] * (width - 1) + [None], 1),
        (n + 3, [float("nan")] * width, 1), (n + 4, [float("inf")] * width, None),
        (n + 5, [0.5] * (width + 1), 2), (None, [0.25] * width, None), (3, rows[3][1], 1), (3, [0.0] * width, 1),
    ]


@pytest.mark.parametrize("n, scale", [(300, 1.0), (290, 3e6), (20, 1e30)])
def test_codes_equal_brute_force(spark, n, scale):
    rows = odd_vectors(n, scale)
    df = spark.createDataFrame([(i, v, y, "x", 1, "y") for i, v, y in rows], VECTORS).repartition(3)
    got = vector_codes.compress(df).collect()
    want, digest = brute_codes(rows)
    sums = defaultdict(int)
    for _, _, e, y in want:
        sums[y] += e or 0
    told = [(i, c, e, sums[y] if any(x[2] is not None for x in want if x[3] == y) else None) for i, c, e, y in want]
    told = [(i, c, e, s if s is None or s < 1 << 63 else None) for i, c, e, s in told]
    assert sorted(map(str, told)) == sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([(1, None, 1, "x", 1, "y")], VECTORS)
    got = vector_codes.compress(none)
    assert got.count() == 0
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_of_fewer_components_than_parts(spark):
    rows = [(i, [float(i % 3), 1.0], None) for i in range(30)]
    df = spark.createDataFrame([(i, v, y, "x", 1, "y") for i, v, y in rows], VECTORS)
    want, digest = brute_codes(rows)
    got = vector_codes.compress(df).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [w[:3] for w in want]
    assert got[0].codebooks_sha256 == digest


def test_dictionary_distances_in_every_width():
    rng = np.random.default_rng(2)
    for scale in (3, 1 << 20, 1 << 45, 1 << 70):
        x = [[int(v * scale) for v in row] for row in rng.normal(size=(40, 5))]
        found = [np.unique(np.array(c, dtype=float) / 1024, return_inverse=True) for c in zip(*x)]
        numbers = np.stack([n.ravel() for _, n in found]).astype(np.uint16)
        block = vector_codes.Block(40, [u for u, _ in found], numbers.tobytes())
        rows = block.part(range(5)).tolist()
        book = rows[:7]
        index, distance = block.nearest(range(5), book)
        for r, i, d in zip(rows, index, distance):
            assert (int(d), int(i)) == min(
                (sum((a - b) ** 2 for a, b in zip(r, e)), k) for k, e in enumerate(book)
            )


def test_limbs_add_up():
    for value in (0, 5, -5, 1 << 39, -(1 << 40), (1 << 200) + 7, -(1 << 130) - 1):
        assert sum(s << 40 * limb for limb, s in vector_codes._limbs(value)) == value


# --- op12 -------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, hash string, norm string, row int, top int, group_size string"


def copies(spark):
    random.seed(5)
    rows = [(i, random.choice(["Same", "sAME", "same ", "ÄB", "äB", "äb", "", None])) for i in range(200)]
    rows += [(500, "twice"), (500, "TWICE"), (500, "twice"), (None, "no id"), (None, "No Id"), (None, "twice")]
    rows += [(600, "x" * 200_000), (601, "X" * 200_000), (602, "x" * 199_999 + "y")]
    rows += [(1000 + i, "hot TEXT") for i in range(400)]
    return rows, spark.createDataFrame([(i, t, "h", "n", 1, 2, "g") for i, t in rows], DOCS).repartition(5)


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("weak", [None, "some", "all"])
def test_copies(spark, weak, monkeypatch):
    """Also where the hash, or the hash and SHA-256, can't tell texts apart."""
    rows, df = copies(spark)
    kinds = {None: exact_dedup.hash128, "some": lambda c: F.substring(exact_dedup.hash128(c), 1, 0),
             "all": lambda c: F.lit(b"\x01")}
    if weak == "all":
        sha2 = F.sha2
        monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.substring(sha2(c, n), 1, 1))
    got = exact_dedup.exact_duplicates(df, kinds[weak]).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower_ascii(t)].append(i)
    want = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: -1 if i is None else i)
        sha = hashlib.sha256(text.encode()).hexdigest()[: 1 if weak == "all" else 64]
        left = True
        for i in ids:
            want.append((i, keep, len(ids), left and i == keep, sha))
            left = left and i != keep
    assert sorted(map(str, want)) == sorted(
        str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got
    )


def test_label_of_texts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id long, text string")
    weak = exact_dedup.normalised(df, lambda c: F.lit(b"\x01"))
    assert exact_dedup.telling_label(weak) == ["hash", "text_sha256"]
    assert exact_dedup.telling_label(exact_dedup.normalised(df, exact_dedup.hash128)) == ["hash"]


def test_copies_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_duplicates(none).count() == 0


# --- op13 -------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth string, rep int, tier int, k1 int"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, sha, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, cs in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(k))
        out.append((
            min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children[k], leaves[k],
            saved[k], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def talks(seed=3, n=260):
    random.seed(seed)
    word = lambda: random.choice(["a", "bé", "ccc 😀", "", None])
    rows = [
        (c, turn if turn else None, random.choice(["user", "assistant", None]), word())
        for c in [*range(n), 1000, 1003, 777] for turn in range(random.randint(1, 7))
    ]
    rows += [(5000 + i, t, "user", "the same") for i in range(300) for t in range(8)]  # one hot path
    rows += [(100, 900, "user", "tie"), (100, 900, "user", "tie"), (100, 900, None, "other"), (None, 1, "user", "x")]
    rows += [(9900, t, "user", f"turn {t}") for t in range(1500)]  # one long conversation
    rows += [(9901, t, "user", f"turn {t}") for t in range(1400)]
    return rows


def told(df):
    return sorted(
        (str((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256))
         for r in df.collect())
    )


@pytest.fixture(scope="module")
def talk(spark):
    rows = talks()
    df = spark.createDataFrame([(*r, "d", 1, 2, 3) for r in rows], TURNS).repartition(4)
    return df, sorted(map(str, brute_trie(rows)))


def test_trie_equals_brute_force(talk):
    df, want = talk
    assert told(conversation_trie.trie(df)) == want


def test_trie_with_spills_small_shards_and_colliding_names(talk, monkeypatch):
    df, want = talk
    monkeypatch.setattr(conversation_trie, "SHARE", 16)
    monkeypatch.setattr(conversation_trie, "PIECE", 50)
    monkeypatch.setattr(conversation_trie, "IDS", 7)
    assert told(conversation_trie.trie(df, held=3, bits=2)) == want


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([(None, 1, "user", "x", "d", 1, 2, 3)], TURNS)
    assert conversation_trie.trie(none).count() == 0


def test_messages_spill_and_add():
    random.seed(9)
    for held, runs in ((2, 1), (5, 2), (1000, 16)):
        queue = conversation_trie.Messages(held, runs)
        want = defaultdict(lambda: [0, 0, 0])
        for _ in range(400):
            order, m = (-random.randint(0, 4), random.randint(0, 9)), [random.randint(0, 9) for _ in range(3)]
            queue.push(order, *m)
            want[order] = [a + b for a, b in zip(want[order], m)]
        asked = [(-d, c) for d in range(4, -1, -1) for c in range(12)]
        assert [queue.pop(o) for o in asked] == [tuple(want[o]) for o in asked]
        assert not queue.heap and not queue.runs


def test_tiers_of_weights(spark):
    share = conversation_trie.SHARE
    weights = [1, share - 1, share, share**2 - 1, share**2, share**3]
    df = spark.createDataFrame([(w,) for w in weights], "w long").select(conversation_trie.tier(F.col("w")).alias("t"))
    assert [r.t for r in df.collect()] == [0, 0, 1, 1, 2, 3]


# --- op8: components of any size ----------------------------------------------------------------


@pytest.mark.parametrize("scale", [1e5, 1e7, 1e12, 1e30, 1e200])
def test_nearest_of_large_components(spark, scale):
    random.seed(8)
    rows = [
        (i, [random.choice([-1, 1]) * random.choice([random.random(), 1.0, 0.0]) * scale for _ in range(3)])
        for i in range(60)
    ] + [(60, [0.5, -0.25, 0.1]), (61, [1e-3, 7.0, -7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = lambda x: int(x) * 64 if abs(x) > 1e20 else math.floor(64 * x)
    x = {i: [whole(c) for c in v] for i, v in rows}
    want = []
    for q in range(0, 62, 20):
        scored = sorted((-sum(a * b for a, b in zip(x[q], v)), i) for i, v in x.items() if i != q)[:20]
        want += [(q, k + 1, i, -s if abs(s) < 1 << 63 else None) for k, (s, i) in enumerate(scored)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vector_search.nearest(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == sorted(want)


# --- rows that repeat an id ---------------------------------------------------------------------


def test_repeated_labelled_rows_count_once(spark, monkeypatch):
    """One row per labelled id reaches the driver, however often it is there."""
    rows = [(7, f"good words number {i % 3}", "x") for i in range(3000)] + [(i, f"bad {i}", "x") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, int(i == 7), int(i % 2)) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "best_cut", lambda raw, y: seen.append(len(raw)) or 0.0)
    quality.train(quality.described(docs), labels)
    assert 0 < seen[0] <= 21
    learned = []
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda sample: learned.append(sample.count()) or toxicity.Lexicon([], [], []))
    toxicity.train(docs.select("doc_id", "text"), labels)
    assert 0 < learned[0] <= 21


def test_repeated_rows_of_long_repeats(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text)] + [(2, "a head " + text + " a tail")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.remove_repeats(docs).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert sorted((r.doc_id, r.n_removed, r.n_spans, r["count"]) for r in got) == [
        (1, 0, 0, 1), (2, len(text), 1, 300),
    ]
