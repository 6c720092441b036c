"""Operators over several documents, and the pipeline, against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pitline.llm import components, decontamination, packing, simhash, substrings, vector_search
from pitline.llm.common import arrow_schema
from pitline.llm.components import connected

DOCS = "doc_id long, text string, lang string, component string, data string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "c", "d", "r") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    random.seed(4)
    long = " ".join(random.choice("some words that come again and again in a text".split()) for _ in range(9000))
    more = [
        (1001, None), (1002, ""), (1003, "  \n"), (1004, "two words"), (1005, "Two\tWORDS"),
        (None, rows[3][1]), (rows[5][0], rows[5][1]), (rows[6][0], rows[6][1] + " changed"),
        (1006, long), (1007, long[:60_000]), (1008, "x" * 200 + long[500:700]), (1009, "ab" * 3000),
        *[(2000 + i, rows[7][1][:400] + f" tail {i}") for i in range(60)],
    ]
    return rows + more


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = np.zeros(64, dtype=int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        counts += np.array([h >> b & 1 for b in range(64)])
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def brute_components(prints, radius=4):
    """The smallest id (null last) of each row's component."""
    f = np.array(prints, dtype=np.uint64)
    label = list(range(len(f)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(f)):
        for b in np.flatnonzero(np.bitwise_count(f[a + 1 :] ^ f[a]) <= radius) + a + 1:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return [root(a) for a in range(len(f))]


def test_simhash_groups(spark, texts):
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    prints = [brute_fingerprint(t or "") for _, t in texts]
    roots = brute_components(prints)
    least = {}
    for (i, _), r in zip(texts, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = Counter(
        (i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(texts, prints, roots, strict=True)
    )
    assert Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("piece", [3, 1024])
def test_trie_walk_finds_all_links(spark, piece):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = set(rng.integers(0, 1 << 63, 300, dtype=np.uint64).tolist())
    for c in centres.tolist():
        for _ in range(12):
            x = c
            for b in rng.integers(0, 64, 3):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, len(prints), piece).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    label = {p: p for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    want = brute_components(prints)
    assert [root(p) for p in prints] == [prints[r] for r in want]


def test_walk_equals_all_pairs():
    rng = np.random.default_rng(2)
    f = np.unique(rng.integers(0, 1 << 10, 300, dtype=np.uint64))
    group = np.sort(rng.integers(0, 3, len(f)))
    x, y = simhash.walk(f, group, 2)
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    want = {
        (a, b) for a in range(len(f)) for b in range(a + 1, len(f))
        if group[a] == group[b] and int(f[a] ^ f[b]).bit_count() <= 2
    }
    assert got == want and len(x) == len(got)


@pytest.mark.parametrize("hubs", [3, 1000])
def test_components(spark, monkeypatch, hubs):
    monkeypatch.setattr(components, "HUBS", hubs)
    random.seed(6)
    chain = [(i, i + 1) for i in range(0, 40)]
    links = [*chain, *[(100, 100 + i) for i in range(1, 30)], (7, 7), (200, 201), (201, 200)]
    random.shuffle(links)
    got = dict(map(tuple, connected(spark.createDataFrame(links, "a long, b long")).collect()))
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_a_hub_stay_spread(spark):
    star = spark.range(1, 200_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    got = connected(star.unionByName(spark.createDataFrame([(-5, 77)], "a long, b long")))
    assert got.agg(F.count("node"), F.min("component"), F.max("component")).first()[:] == (200_002, -5, -5)


def test_keep_one_of_each_group(spark, texts):
    kept = simhash.keep_one(frame(spark, texts)).collect()
    roots = brute_components([brute_fingerprint(t or "") for _, t in texts])
    least = {}
    for (i, _), r in zip(texts, roots, strict=True):
        key = (i is None, i)
        least[r] = min(least.get(r, key), key)
    assert sorted(r.doc_id for r in kept) == sorted(k[1] for k in least.values())
    assert list(kept[0].asDict()) == ["doc_id", "text", "lang", "component", "data", "rank"]
    assert simhash.keep_one(frame(spark, [])).count() == 0


def brute_cut(rows):
    """(doc_id, bytes, removed, runs, digest) by all 50-byte strings of smaller ids."""
    seen, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for q in range(len(b) - 49):
            if i is not None:
                seen[b[q : q + 50]] = min(seen.get(b[q : q + 50], i), i)
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for q in range(len(b) - 49):
            if i is not None and seen[b[q : q + 50]] < i:
                m[q : q + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        out.append((i, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("buffer, held", [(1 << 19, 1_500_000), (900, 700)])
def test_repeats(spark, texts, monkeypatch, buffer, held):
    """Also with tiny buffers and flushes, which cut documents and spread passages over them."""
    rows = [r for r in texts if r[0] is None or r[0] % 2 == 0 or r[0] > 1000]
    got = Counter(map(tuple, substrings.remove_repeats(frame(spark, rows)).collect()))
    assert got == brute_cut(rows)
    monkeypatch.setattr(substrings, "BUFFER", buffer)
    monkeypatch.setattr(substrings, "SORTED", held)
    substrings._POWERS.clear()
    keyed = [(i, zlib.crc32(f"{i} {t}".encode()) >> 1, t or "") for i, t in rows if i is not None]
    n = 5
    schema = arrow_schema(substrings.ROWS)
    assert _steps(keyed, n, schema) == brute_cut([r for r in rows if r[0] is not None])
    substrings._POWERS.clear()


def _steps(keyed, n_buckets, schema):
    """The steps of ``remove_repeats`` without Spark, several tasks each."""
    import pyarrow as pa

    def tasks(columns, names, size=25):
        for at in range(0, len(columns[0]), size):
            yield [pa.RecordBatch.from_arrays([pa.array(c[at : at + size]) for c in columns], names)]

    def met(batches, meet):
        tables = pa.Table.from_batches(list(batches), schema)
        for b in range(n_buckets):
            mine = tables.filter(pa.array([x == b for x in tables["bucket"].to_pylist()], pa.bool_()))
            if len(mine):
                yield from meet(mine).to_pylist()

    columns = [list(c) for c in zip(*keyed, strict=True)]
    rows = (b for t in tasks(columns, ["i", "k", "t"]) for b in substrings._span_rows(n_buckets)(t))
    found = list(met(rows, substrings._meet_spans))
    aside = {}
    for r in found:
        if r["kind"] == substrings.ASIDE:
            aside.setdefault((r["doc_id"], r["row_key"]), []).append(r["data"])
    with_spans = [(i, k, t, aside[i, k]) for i, k, t in keyed if (i, k) in aside]
    columns = [list(c) for c in zip(*with_spans, strict=True)]
    rows = (b for t in tasks(columns, ["i", "k", "t", "s"]) for b in substrings._window_rows(n_buckets)(t))
    found += met(rows, substrings._meet_windows)
    data = {}
    for r in found:
        if r["kind"] == substrings.SETTLED:
            data.setdefault((r["doc_id"], r["row_key"]), []).append(r["data"])
    return Counter((i, *substrings.cut(t.encode(), data.get((i, k)))) for i, k, t in keyed)


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    got = substrings.remove_repeats(frame(spark, [(1, None), (None, "y" * 90), (3, "y" * 90)])).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == [(0, 0), (90, 0), (90, 0)]


def test_packing_round_trip(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    extra = [(3000, "İstanbul ΑΣ ſ 日本 <|endoftext|> it's\tthey'll\x0b3a4"), (3001, "it's THEY'LL 42ab ½ x²")]
    rows = texts + extra
    got = packing.pack(frame(spark, rows), limit=512).collect()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[at : at + 512], dtype="<u4").tobytes()
            want[(i, k, at, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        free = 0
        for offset, length in sorted(parts):
            assert offset == free
            free += length
        assert free <= 512
    lengths = [r.length for r in got]
    assert len(by) == best_fit(lengths, 512)
    assert len(by) <= 11 / 9 * -(-sum(lengths) // 512) + 1  # known of best fit decreasing
    assert packing.pack(frame(spark, [])).count() == 0


def best_fit(lengths, limit):
    """Sequences that placing the pieces one by one takes, longest first, into the tightest gap."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(limit - n)
    return len(gaps)


def test_runs_equal_best_fit():
    random.seed(8)
    for _ in range(60):
        limit = random.choice([7, 30, 100])
        lengths = [random.randint(1, limit) for _ in range(random.randint(1, 200))]
        runs = packing.Runs(Counter(lengths), limit)
        assert runs.sequences == best_fit(lengths, limit)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * 0.4).tolist()) for i in range(400)]
    rows += [(400 + i, rows[20][1]) for i in range(30)] + [rows[40], (500, None), (501, []), (None, rows[1][1])]
    rows += [(502, [float("nan")] * 8), (503, [None] + [0.1] * 7), (504, [float("inf")] * 8), (505, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(9))
    got = vector_search.nearest(df, F.col("vec_id") % 20 == 0, 20)
    x = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in rows[:430]}
    want = []
    for q in (i for i in x if i % 20 == 0):
        scored = sorted((-int(x[q] @ v), i) for i, v in x.items() if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert vector_search.nearest(df.limit(0), F.lit(True)).count() == 0


def brute_passages(rows, items):
    found = {}
    counted = [(i, ws, Counter(decontamination.shingles_of(ws))) for i, t in items
               if (ws := decontamination.WORD.findall((t or "").lower()))]
    for d, t in rows:
        words = decontamination.WORD.findall((t or "").lower())
        for i, ws, shingles in counted:
            n = min(len(ws), len(words))
            best = max(
                (decontamination.similarity(Counter(decontamination.shingles_of(words[s : s + n])), shingles)
                 for s in range(len(words) - n + 1 if n else 0)), default=0)
            if best >= decontamination.SIMILARITY:
                found[d, i] = pytest.approx(best)
    return found


def test_benchmark_passages(spark, sf):
    random.seed(9)
    vocabulary = [f"w{k}" for k in range(400)]
    say = lambda n: [random.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(random.choice([15, 22, 40])))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "just four words here"), (53, items[0][1].upper() + "!")]
    rows = []
    for d in range(60):
        words = say(120)
        if d % 2:
            passage = items[d % 12][1].split()
            if d % 3 == 0:
                passage[-1] = "other"
            words[30:30] = passage
        rows.append((d, ", ".join(words)))
    rows += [(100, None), (101, ""), (102, items[3][1]), (103, items[4][1].rsplit(" ", 2)[0]), (104, "Just four words here")]
    docs = frame(spark, rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("lang", F.lit(1))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find_passages(docs, benchmark).collect()}
    want = brute_passages(rows, items)
    assert got == want and len(want) > 30
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs, benchmark).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    assert decontamination.find_passages(docs, benchmark.limit(0)).count() == 0
    assert decontamination.drop_contaminated(docs.limit(0), benchmark).count() == 0
    blocks = list(decontamination.item_blocks(benchmark, chars=300))
    assert len(blocks) > 3 and sum(len(b.items) for b in blocks) == 14
    assert len(spark.read.parquet(f"{sf}/benchmark.parquet").columns) == 2


def test_passages_with_foreign_words(spark):
    """Words of no item count as different words, however the benchmark is cut into blocks."""
    say = lambda k, n: [f"i{k}x{j}" for j in range(n)]
    items = [(k, " ".join(say(k, n))) for k, n in enumerate([59, 59, 200, 200, 80, 30])]
    rows = []
    for d, (k, new) in enumerate([(0, 7), (1, 3), (2, 30), (3, 10), (4, 12), (5, 8), (0, 0), (3, 21)]):
        words = say(k, len(items[k][1].split()))
        words[len(words) - new :] = [f"foreign{d}n{j}" for j in range(new)]
        rows.append((d, " ".join(words)))
    passage = say(0, 59)
    passage[-7:] = say(4, 7)  # words of another item, maybe of another block
    rows += [(20, " ".join(passage)), (21, " ".join(["foreign"] * 90 + passage[:56] + ["foreign"] * 90))]
    want = brute_passages(rows, items)
    assert {d for d, _ in want} == {1, 3, 6, 7, 21}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    found = decontamination.find_passages(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == want
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs, benchmark).collect()}
    assert kept == {0, 2, 4, 5, 20}
    blocks = list(decontamination.item_blocks(benchmark, chars=100))
    assert sum(bool(b.items) for b in blocks) > 2
    apart = {(d, f[0]): f[1] for d, t in rows for b in blocks for f in b.search(t)}
    assert apart == {k: pytest.approx(v.expected, abs=1e-12) for k, v in want.items()}


def test_pipeline(spark):
    """Each stage does to its own input what the operator's plain form does."""
    from pitline.session import materialize

    sf = "/root/testdata/sf0.01"  # the smallest table has too few toxic labels to learn from

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_llm", F.lit("extra"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf))
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = {n: ({r.doc_id for r in b.collect()}, {r.doc_id for r in a.collect()}) for n, (b, a) in seen.items()}
    before, after = ids["near_duplicates"]
    texts = [(r.doc_id, r.text) for r in seen["near_duplicates"][0].collect()]
    roots = brute_components([brute_fingerprint(t) for _, t in texts])
    least = {}
    for (i, _), r in zip(texts, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    assert after == set(least.values())
    before, after = ids["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in seen["decontamination"][0].collect()]
    some = [r for r in rows if any(" ".join(t.split()[3:8]) in r[1] for _, t in items)]
    assert before - after == {d for d, _ in brute_passages(some, items)}
    before, after = ids["toxicity"]
    assert 0 < len(before - after) < 0.2 * len(before)
    assert ids["pii"][0] == ids["pii"][1]
    assert seen["pii"][1].where(r"text rlike '@[A-Za-z0-9-]+[.][a-z]'").count() == 0
    assert ids["packing"][0] == ids["packing"][1]
    final = corpus_pipeline.run(spark, sf)
    assert final.count() == seen["packing"][1].count()
