"""Benchmark passages in documents: SimHash of item-sized windows, multi-index look-up, exact check.

A window has as many words as the item it is compared with. Windows that share a five-word shingle
with an item, which every window within reach of the threshold does, get a SimHash of their weighted
shingles. The fingerprints of the items of one length are cut into ``RADIUS`` + 1 blocks with one table
per block, so that every item within ``RADIUS`` bits of a window agrees with it in at least one block
and is found. Candidates within the radius are verified by the weighted Jaccard similarity of the two
multisets of shingles; a shingle weighs as much as it has distinct words. A word is its 64-bit hash
everywhere, in the benchmark or not, so nothing depends on which items share a block.

The benchmark is taken in blocks of bounded text, one pass over the documents each, so that what is
sent to the tasks doesn't grow. Words are lower-cased runs of letters and digits. Items without words
are left out, items of fewer than five words are one shingle. Null or empty text: no passage. Repeated
rows are searched once each; a null id stays null.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.llm.common import id_and_text, map_columns

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BITS = 64
#: Characters of benchmark text searched for in one pass.
BLOCK_CHARS = 4_000_000
#: Windows fingerprinted at once.
WINDOWS = 2048
WORD = re.compile(r"[^\W_]+")
#: Odd multipliers of the words of a shingle and of the mixing of its hash.
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_id(word: str) -> int:
    """A number of the word alone; 0 is kept for words not looked up yet."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7) or 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    return h ^ (h >> np.uint64(29))


def shingles_of(ids) -> list[tuple]:
    """Runs of five word numbers, or the whole sequence if it is shorter."""
    n = max(1, len(ids) - SHINGLE + 1)
    return [tuple(ids[i : i + SHINGLE]) for i in range(n)]


def weight(shingle: tuple) -> float:
    return len(set(shingle)) / len(shingle)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    both = sum(min(n, b[s]) * weight(s) for s, n in a.items() if s in b)
    every = sum(n * weight(s) for s, n in a.items()) + sum(n * weight(s) for s, n in b.items())
    return both / (every - both)


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(ids) - size + 1, dtype=np.uint64)
    for j in range(size):
        h += ids[j : j + len(h)].astype(np.uint64) * MULTIPLIERS[j]
    return mixed(h)


def window_fingerprints(ids: np.ndarray, size: int, length: int) -> np.ndarray:
    """SimHash of every window of ``length`` words of ``ids``, by sums over its shingles."""
    h = shingle_hashes(ids, size)
    words = np.lib.stride_tricks.sliding_window_view(ids, size)
    ordered = np.sort(words, axis=1)
    weights = (1 + (ordered[:, 1:] != ordered[:, :-1]).sum(axis=1)) / size
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((len(h) + 1, BITS))
    np.cumsum((bits * 2.0 - 1.0) * weights[:, None], axis=0, out=total[1:])
    n = length - size + 1
    sums = total[n:] - total[:-n]
    return np.packbits(sums > 1e-9, axis=1, bitorder="little").view("<u8").ravel()


class Items:
    """A block of the benchmark, indexed."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[str, int] = {}
        self.items: list[tuple] = []  # id, length, multiset of shingles
        self.short: dict[int, list[int]] = defaultdict(list)  # lengths under a shingle
        owners: dict[tuple, set[int]] = defaultdict(set)
        prints: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            words = WORD.findall((text or "").lower())
            if not words:
                continue
            ids = [self.words.setdefault(w, word_id(w)) for w in words]
            at, size = len(self.items), min(SHINGLE, len(ids))
            self.items.append((item, len(ids), Counter(shingles_of(ids))))
            for s in set(shingles_of(ids)):
                owners[s].add(at)
            fp = window_fingerprints(np.array(ids, dtype=np.uint64), size, len(ids))[0]
            prints[len(ids)].append((at, int(fp)))
        self.sizes = sorted({min(SHINGLE, n) for _, n, _ in self.items}, reverse=True)
        self.lookup = {}
        for size in self.sizes:
            own = [s for s in owners if len(s) == size]
            h = shingle_hashes(np.array(own, dtype=np.uint64).reshape(-1), size)[::size]
            order = np.argsort(h)
            lengths = [
                sorted({self.items[i][1] for i in owners[own[k]]}) for k in order.tolist()
            ]
            self.lookup[size] = h[order], lengths
        edges = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
        self.blocks = [(a, (1 << (b - a)) - 1) for a, b in itertools.pairwise(edges)]
        self.tables = {
            n: [self._table(found, a, m) for a, m in self.blocks] for n, found in prints.items()
        }

    @staticmethod
    def _table(found, shift, mask):
        table = defaultdict(list)
        for item, fp in found:
            table[fp >> shift & mask].append((item, fp))
        return dict(table)

    def candidates(self, fp: int, length: int) -> list[int]:
        """Items of ``length`` words whose fingerprint is within the radius."""
        found = {}
        for (shift, mask), table in zip(self.blocks, self.tables[length], strict=True):
            found.update(table.get(fp >> shift & mask, ()))
        return [i for i, own in found.items() if (own ^ fp).bit_count() <= RADIUS]

    def search(self, text: str) -> list[tuple]:
        """(item id, similarity, first word, words) of the best window for each item found."""
        words = WORD.findall(text.lower())
        if not words or not self.items:
            return []
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        best: dict[int, tuple[float, int, int]] = {}
        marked = [(size, self._windows(ids, size)) for size in self.sizes]
        if any(windows for _, windows in marked):
            for k in np.flatnonzero(ids == 0).tolist():  # words of no item stay distinct
                ids[k] = word_id(words[k])
        for size, windows in marked:
            for length, starts in windows.items():
                self._check(ids, size, length, starts, best)
        return [(self.items[i][0], *found) for i, found in sorted(best.items())]

    def _windows(self, ids: np.ndarray, size: int) -> dict[int, np.ndarray]:
        """Starts of the windows that hold a shingle of an item, by the item's length."""
        if len(ids) < size:
            return {}
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        at = np.flatnonzero(known[size:] - known[:-size] == size)
        if not len(at):
            return {}
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(size):
            h += ids[at + j].astype(np.uint64) * MULTIPLIERS[j]
        h = mixed(h)
        own, lengths = self.lookup[size]
        k = np.minimum(np.searchsorted(own, h), len(own) - 1)
        hit = own[k] == h
        marks: dict[int, np.ndarray] = {}
        for p, i in zip(at[hit].tolist(), k[hit].tolist(), strict=True):
            for length in lengths[i]:
                last = max(0, len(ids) - length)  # a shorter text is one window
                m = marks.setdefault(length, np.zeros(last + 2, dtype=np.int32))
                m[min(last, max(0, p - length + size))] += 1
                m[min(last, p) + 1] -= 1
        return {n: np.flatnonzero(np.cumsum(m[:-1]) > 0) for n, m in marks.items()}

    def _check(self, ids, size, length, starts, best):
        words = min(length, len(ids))
        runs = np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1)
        for run in runs:
            for a in range(int(run[0]), int(run[-1]) + 1, WINDOWS):
                b = min(int(run[-1]) + 1, a + WINDOWS)
                part = ids[a : b - 1 + words]
                for k, fp in enumerate(window_fingerprints(part, size, words).tolist()):
                    for i in self.candidates(fp, length):
                        window = Counter(shingles_of(part[k : k + words].tolist()))
                        s = similarity(window, self.items[i][2])
                        if s >= SIMILARITY and (i not in best or s > best[i][0] + 1e-12):
                            best[i] = s, a + k, words


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS):
    """The benchmark's items in blocks of about ``chars`` characters, one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // chars)
    for k in range(n):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Items(sorted((tuple(r) for r in mine.collect()), key=lambda r: (r[0] is None, r)))


SCHEMA = "doc_id long, item_id long, similarity double, first_word int, n_words int"


def _searcher(items: Items):
    def work(ids, texts):
        out = {c: [] for c in ("doc_id", "item_id", "similarity", "first_word", "n_words")}
        for doc, text in zip(ids, texts, strict=True):
            for found in items.search(text):
                for c, v in zip(out, (doc, *found), strict=True):
                    out[c].append(v)
        return out

    return work


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the best window of each item that a document holds."""
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for items in item_blocks(benchmark):
        part = map_columns(id_and_text(docs), lambda items=items: _searcher(items), SCHEMA)
        found = found.unionByName(part)
    return found


def _is_clean(items: Items):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not items.search(t) for t in texts.fillna("")], dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns."""
    for items in item_blocks(benchmark):
        docs = docs.where(_is_clean(items)(F.col("text").cast("string")))
    return docs
