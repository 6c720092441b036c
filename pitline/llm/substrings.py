"""Removal of repeated passages: bytes covered by a 50-byte string of an earlier document.

Suffixes are compared by prefix polynomial hashes, so a common extension of any length is one
subtraction and one multiplication away. Sorting every suffix of a corpus would move many times its
size; so the sort is sparse. In every 50-byte window the smallest of its 25-byte hashes (the leftmost
one) is its *anchor*. Equal windows have equal anchors at equal places, so two suffixes with a common
50-byte string meet among the anchors. Neighbouring windows with one anchor form a *span*; about one
byte in 13 starts one.

1. Each task sorts the spans of some megabytes by anchor hash, then by the hash of the whole span. A
   span that also stands in a smaller document of the task is settled there. An anchor that several
   documents of the task have in different spans is *mixed*: its other spans are set aside, and one of
   them goes on as a marker. All other spans go on. So a task sends at most one document's spans for
   an anchor, however many documents hold it.
2. Spark brings equal anchors together, by ranges of their hash. Sorted in the same way, spans that
   also stand in a smaller document are settled; the others of mixed anchors are set aside.
3. The windows of the spans set aside, the edges of passages, are sorted by their own hash, in each
   task first and then over all, and settled if they stand in a smaller document. Candidate matches
   are verified with a second, independent hash.
4. Each document's settled intervals meet its text.

Hashes are 64-bit polynomials with an odd base and a mixing step. Spans are compared by 88 bits and
windows by 96, so with 10**12 spans a false match is expected in fewer than one of 100 runs.

Null or empty text: nothing to remove. Rows with a null id neither lose bytes nor make others lose
any. Rows that repeat an id and text get the same result; rows that share an id don't count as smaller
than each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.llm.common import arrow_schema, id_and_text, settled

WINDOW = 50
GRAM = 25
#: Bytes hashed at once, spans and windows a task sorts at once.
BUFFER = 1 << 19
SORTED = 700_000
#: Bytes of text whose spans meet in one bucket, about, and buckets at least.
BUCKET_TEXT = 5_000_000
BUCKETS = 64

BASE = 0x9E3779B97F4A7C15
BASE2 = 0xD6E8FEB86659FD93
U = np.uint64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, computed once per process."""
    if base not in _POWERS:
        n = BUFFER + 4 * WINDOW
        up, down = np.full(n, base, dtype=U), np.full(n, pow(base, -1, 1 << 64), dtype=U)
        up[0] = down[0] = 1
        _POWERS[base] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _POWERS[base]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


class Prefix:
    """Prefix hashes of a buffer: the hash of any part in constant time."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        up, self.down = _powers(base)
        self.sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.sums[1:], dtype=U)

    def parts(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        """The hash of every part of ``size`` bytes."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
    """The spans of texts that lie in one buffer, at [starts, stops).

    Returns anchor hash, span hash, first window and last window (positions in the buffer).
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    prefix = Prefix(data)
    gram = prefix.windows(GRAM)
    low = U((1 << 20) - 1)
    key = (gram & ~low) | np.arange(len(gram), dtype=U)  # equal hashes: the leftmost is smallest
    width, least = 1, key
    while width * 2 <= WINDOW - GRAM + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = WINDOW - GRAM + 1 - width
    least = np.minimum(least[: n], least[rest : n + rest])
    anchor = (least & low).astype(np.int64)
    inside = np.zeros(n + 1, dtype=bool)
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        if b - a >= WINDOW:
            inside[a : b - WINDOW + 1] = True
    same = np.empty(n, dtype=bool)
    same[0] = False
    same[1:] = (anchor[1:] == anchor[:-1]) & inside[: n - 1]
    first = np.flatnonzero(inside[:n] & ~same)
    follows = np.append(same[1:], False) & inside[1:]
    last = np.flatnonzero(inside[:n] & ~follows)
    at = anchor[first]
    k = prefix.parts(first, last + WINDOW)
    k = mixed(k + (at - first).astype(U) * U(BASE2))
    return gram[at], k, first, last


def buffers(texts: list[bytes]):
    """(buffer, text numbers, their starts and stops in it, offset of each in its text).

    Texts are laid end to end; a long one is cut into parts that overlap by a window less a byte.
    """
    held, where, size = [], [], 0

    def full():
        data = np.frombuffer(b"".join(held), dtype=np.uint8)
        w = np.array(where, dtype=np.int64).reshape(-1, 4)
        return data, w[:, 0], w[:, 1], w[:, 2], w[:, 3]

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WINDOW + 1), BUFFER - WINDOW):
            part = text[at : at + BUFFER - 1]
            if size + len(part) > BUFFER and held:
                yield full()
                held, where, size = [], [], 0
            held.append(part)
            where.append((i, size, size + len(part), at))
            size += len(part)
    if held:
        yield full()


def groups(*keys: np.ndarray) -> np.ndarray:
    """For rows sorted by the keys: True where a new group starts."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def ranges(key: np.ndarray) -> list[tuple[int, int]]:
    """First row and end of each group of a sorted key."""
    at = np.flatnonzero(groups(key)).tolist()
    return list(zip(at, [*at[1:], len(key)], strict=True)) if at else []


def spread(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Give every row the value of its group's first row."""
    return values[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]


def judged(h, k, doc):
    """Sort spans by anchor hash, span hash and document.

    Returns the order and, in it: the number of the row's anchor, whether the span also stands in a
    smaller document, whether the anchor stands in several documents, and whether in several spans.
    """
    order = np.lexsort((doc, k, h))
    h, k, doc = h[order], k[order], doc[order]
    anchor, span = groups(h), groups(h, k)
    known = doc > spread(span, doc)
    number = np.cumsum(anchor) - 1
    at = np.flatnonzero(anchor)
    documents = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
    spans_ = np.add.reduceat(span.astype(np.int64), at) > 1
    return order, number, known, documents[number], spans_[number]


def merged(start: np.ndarray, stop: np.ndarray, doc: np.ndarray):
    """Unite intervals of a document that overlap or touch; returns them sorted by document."""
    order = np.lexsort((stop, start, doc))
    start, stop, doc = (x[order].astype(np.int64) for x in (start, stop, doc))
    new = groups(doc)
    number = np.cumsum(new)
    reach = np.maximum.accumulate(stop + number * (1 << 40)) - number * (1 << 40)
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return start, stop, doc
    return start[at], np.maximum.reduceat(stop, at), doc[at]


#: kind 0: sorted rows for a bucket; kinds 1 and 2: intervals and spans set aside of a document.
ROWS = (
    "kind int, bucket int, doc_id long, row_key long, docs binary, keys binary, h binary, k binary, "
    "doc binary, start binary, width binary"
)
SHIP, SETTLED, ASIDE = 0, 1, 2
#: Added to the width of a span that goes on for a mixed anchor.
MIXED = 128
RESULT = "kind int, doc_id long, row_key long, data binary"


class _Rows:
    """Collects output rows of ``ROWS``."""

    def __init__(self):
        self.columns = [[] for _ in range(11)]

    def add(self, *values):
        for c, v in zip(self.columns, values, strict=True):
            c.append(v)

    def per_document(self, kind, ids, keys, doc, pairs, n_buckets):
        """One row per document with its pairs of numbers; ``doc`` is sorted."""
        for a, b in ranges(doc):
            d = int(doc[a])
            data = pairs[a:b].astype("<i8").tobytes()
            bucket = (int(keys[d]) & 0xFFFFFFFF) % n_buckets
            self.add(kind, bucket, int(ids[d]), int(keys[d]), *[None] * 5, data, None)

    def batches(self, schema):
        types = [f.type for f in schema]
        arrays = [pa.array(c, t) for c, t in zip(self.columns, types, strict=True)]
        whole = pa.RecordBatch.from_arrays(arrays, schema=schema)
        for at in range(0, whole.num_rows, 256):
            yield whole.slice(at, 256)


def _ship(out: _Rows, n_buckets, ids, keys, h, k, doc, start, width):
    """Cut rows into buckets by h; only the documents named go along.

    Anchors are the smallest hashes of their windows, so h is mixed once more for an even cut.
    """
    bucket = ((mixed(h * U(BASE2)) >> U(32)) * U(n_buckets) >> U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, h, k, doc, start, width = (x[order] for x in (bucket, h, k, doc, start, width))
    for a, b in ranges(bucket):
        named, own = np.unique(doc[a:b], return_inverse=True)
        small = "<u2" if len(named) < 1 << 16 else "<u4"
        out.add(
            SHIP, int(bucket[a]), None, None,
            _deltas(ids[named]), keys[named].astype("<i4").tobytes(),
            _pack(h[a:b], 40), _pack(k[a:b], 48), own.astype(small).tobytes(),
            start[a:b].astype("<u4").tobytes(), width[a:b].astype("u1").tobytes(),
        )


def _deltas(ids: np.ndarray) -> bytes:
    """The smallest id and what the others add to it, in four bytes each if that is enough."""
    base = ids.min()
    more = (ids.astype("<i8") - base).view(U)
    small = more.max() < 1 << 32
    return base.astype("<i8").tobytes() + more.astype("<u4" if small else "<u8").tobytes()


def _ids(data: bytes, n: int) -> np.ndarray:
    base = np.frombuffer(data[:8], "<i8")
    more = np.frombuffer(data[8:], "<u4" if len(data) == 8 + 4 * n else "<u8")
    return base + more.astype(U).view(np.int64)


def _pack(x: np.ndarray, bits: int) -> bytes:
    """The lowest bits of each number, column of bytes by column."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : bits // 8]).tobytes()


def _unpack(data: bytes, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, bits // 8)
    full = np.zeros((len(raw), 8), dtype=np.uint8)
    full[:, : bits // 8] = raw
    return full.view("<u8").ravel()


def _received(table: pa.Table):
    """The shipped rows of a bucket: ids, keys, h, k, doc (number), start, width."""
    ids, keys, hs, ks, docs, starts, widths, n = [], [], [], [], [], [], [], 0
    for row in table.to_pylist():
        if row["kind"] != SHIP:
            continue
        key = np.frombuffer(row["keys"], "<i4")
        small = "<u2" if len(key) < 1 << 16 else "<u4"
        ids.append(_ids(row["docs"], len(key)))
        keys.append(key)
        hs.append(_unpack(row["h"], 40))
        ks.append(_unpack(row["k"], 48))
        docs.append(np.frombuffer(row["doc"], small).astype(np.int32) + n)
        starts.append(np.frombuffer(row["start"], "<u4"))
        widths.append(np.frombuffer(row["width"], "u1"))
        n += len(key)
    if not n:
        return None
    return tuple(map(np.concatenate, (ids, keys, hs, ks, docs, starts, widths)))


def _texts(batches):
    """(ids, row keys, texts as bytes) of small parts of the input."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            keys = part.column(1).to_numpy(zero_copy_only=False)
            texts = part.column(2).cast(pa.binary()).to_pylist()
            extra = part.column(3).to_pylist() if part.num_columns > 3 else None
            yield ids, keys, texts, extra


class _Held:
    """Spans or windows of a task until it sorts them."""

    def __init__(self):
        self.ids, self.keys, self.parts, self.n = [], [], [], 0
        self.documents = 0

    def add(self, ids, keys):
        self.ids.append(ids)
        self.keys.append(keys)
        base, self.documents = self.documents, self.documents + len(ids)
        return base

    def rows(self, *columns):
        self.parts.append(columns)
        self.n += len(columns[0])

    def taken(self):
        columns = tuple(map(np.concatenate, zip(*self.parts, strict=True)))
        return np.concatenate(self.ids), np.concatenate(self.keys), columns


def _span_rows(n_buckets: int):
    """Step 1."""

    def flush(held: _Held, schema):
        ids, keys, (h, k, doc, start, width) = held.taken()
        rank = np.unique(ids, return_inverse=True)[1]
        order, _, known, documents, several = judged(h, k, rank[doc])
        h, k, doc, start, width = (x[order] for x in (h, k, doc, start, width))
        mixed = documents & several
        out = _Rows()
        s, e, d = merged(start[known], start[known] + width[known] + WINDOW - 1, doc[known])
        out.per_document(SETTLED, ids, keys, d, np.column_stack([s, e]), n_buckets)
        aside = np.flatnonzero(mixed & ~known)
        aside = aside[np.argsort(doc[aside], kind="stable")]
        pairs = np.column_stack([start[aside], width[aside]])
        out.per_document(ASIDE, ids, keys, doc[aside], pairs, n_buckets)
        first = np.lexsort((rank[doc], h))  # the smallest document's first span of each anchor
        marker = np.zeros(len(h), dtype=bool)
        marker[first[groups(h[first])]] = True
        marker &= mixed
        send = marker | ~(mixed | known)
        width = width + marker.astype(np.uint8) * np.uint8(MIXED)
        _ship(out, n_buckets, ids, keys, *(x[send] for x in (h, k, doc, start, width)))
        yield from out.batches(schema)

    def run(batches):
        schema, held = arrow_schema(ROWS), _Held()
        for ids, keys, texts, _ in _texts(batches):
            base = held.add(ids, keys)
            for data, text, a, b, offset in buffers(texts):
                h, k, first, last = spans(data, a, b)
                if len(h):
                    part = np.searchsorted(a, first, "right") - 1
                    start = first - a[part] + offset[part]
                    held.rows(
                        h, k, (text[part] + base).astype(np.int32), start.astype(np.uint32),
                        (last - first + 1).astype(np.uint8),
                    )
            if held.n >= SORTED:
                yield from flush(held, schema)
                held = _Held()
        if held.n:
            yield from flush(held, schema)

    return run


def _passed_on(table: pa.Table, out):
    """Rows of documents only pass through."""
    kept = table.filter(pa.compute.greater(table.column("kind"), SHIP))
    out.append(
        kept.select(["kind", "doc_id", "row_key"]).append_column("data", kept.column("start"))
    )


def _by_document(kind, ids, keys, doc, pairs, out):
    rows = _Rows()
    rows.per_document(kind, ids, keys, doc, pairs, 1)
    c = rows.columns
    out.append(
        pa.table(
            {
                "kind": pa.array(c[0], pa.int32()), "doc_id": pa.array(c[2], pa.int64()),
                "row_key": pa.array(c[3], pa.int64()), "data": pa.array(c[9], pa.binary()),
            }
        )
    )


def _result(parts: list[pa.Table]) -> pa.Table:
    schema = arrow_schema(RESULT)
    return pa.concat_tables([p.cast(schema) for p in parts])


def _meet_spans(table: pa.Table) -> pa.Table:
    """Step 2, for one bucket."""
    import pyarrow.compute  # noqa: F401

    out: list[pa.Table] = []
    _passed_on(table, out)
    got = _received(table)
    if got:
        ids, keys, h, k, doc, start, width = got
        order, number, known, documents, several = judged(h, k, ids[doc])
        doc, start, width = doc[order], start[order], width[order]
        marked = np.bincount(number, width >= MIXED) > 0
        mixed = documents & (several | marked[number])
        width = width % np.uint8(MIXED)
        s, e, d = merged(start[known], start[known] + width[known] + WINDOW - 1, doc[known])
        _by_document(SETTLED, ids, keys, d, np.column_stack([s, e]), out)
        aside = np.flatnonzero(mixed & ~known)
        aside = aside[np.argsort(doc[aside], kind="stable")]
        _by_document(ASIDE, ids, keys, doc[aside], np.column_stack([start[aside], width[aside]]), out)
    return _result(out)


def _pairs(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs or ()), "<i8").reshape(-1, 2)


def _window_rows(n_buckets: int):
    """Step 3, in each task: hashes of the windows set aside."""

    def flush(held: _Held, schema):
        ids, keys, (h, k, doc, start) = held.taken()
        rank = np.unique(ids, return_inverse=True)[1]
        order, _, known, _, _ = judged(h, k, rank[doc])
        h, k, doc, start = (x[order] for x in (h, k, doc, start))
        out = _Rows()
        s, e, d = merged(start[known], start[known] + WINDOW, doc[known])
        out.per_document(SETTLED, ids, keys, d, np.column_stack([s, e]), n_buckets)
        rest = tuple(x[~known] for x in (h, k, doc, start))
        _ship(out, n_buckets, ids, keys, *rest, np.ones(len(rest[0]), dtype=np.uint8))
        yield from out.batches(schema)

    def run(batches):
        schema, held = arrow_schema(ROWS), _Held()
        for ids, keys, texts, extra in _texts(batches):
            base = held.add(ids, keys)
            for i, text in enumerate(texts):
                held.rows(*_windows_of(text, _pairs(extra[i]), i + base))
                if held.n >= SORTED:
                    yield from flush(held, schema)
                    held = _Held()
                    base = held.add(ids, keys)
        if held.n:
            yield from flush(held, schema)

    return run


def _windows_of(text: bytes, pairs: np.ndarray, doc: int):
    """Both hashes, document and start of each window of the spans (start, width) of a text."""
    pairs = np.unique(pairs, axis=0)
    starts = np.unique(
        np.repeat(pairs[:, 0] - np.concatenate([[0], np.cumsum(pairs[:-1, 1])]), pairs[:, 1])
        + np.arange(pairs[:, 1].sum())
    )
    data = np.frombuffer(text, dtype=np.uint8)
    hs, ks = [np.zeros(0, U)], [np.zeros(0, U)]
    step = BUFFER - WINDOW
    for at in range(0, len(data), step):
        mine = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + step)] - at
        if len(mine):
            part = data[at : at + step + WINDOW]
            hs.append(Prefix(part).parts(mine, mine + WINDOW))
            ks.append(Prefix(part, BASE2).parts(mine, mine + WINDOW))
    doc = np.full(len(starts), doc, dtype=np.int32)
    return np.concatenate(hs), np.concatenate(ks), doc, starts.astype(np.uint32)


def _meet_windows(table: pa.Table) -> pa.Table:
    """Step 3, for one bucket."""
    import pyarrow.compute  # noqa: F401

    out: list[pa.Table] = []
    _passed_on(table, out)
    got = _received(table)
    if got:
        ids, keys, h, k, doc, start, _ = got
        order, _, known, _, _ = judged(h, k, ids[doc])
        doc, start = doc[order][known], start[order][known]
        s, e, d = merged(start, start + WINDOW, doc)
        _by_document(SETTLED, ids, keys, d, np.column_stack([s, e]), out)
    return _result(out)


def _removed(batches):
    """Step 4: the digest columns of each document."""
    schema = arrow_schema(DIGEST)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids = part.column(0)
            rows = [cut(*x) for x in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True)]
            columns = [ids, *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def cut(text: bytes, blobs):
    """(bytes, removed, runs, digest of the rest) of a text with its intervals."""
    pairs = _pairs(blobs)
    zero = np.zeros(len(pairs), dtype=np.int64)
    s, e, _ = merged(pairs[:, 0], pairs[:, 1], zero)
    digest, free = hashlib.sha256(), 0
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        digest.update(text[free:a])
        free = b
    digest.update(text[free:])
    return len(text), int((e - s).sum()), len(s), digest.hexdigest()


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def intervals(keyed: DataFrame, n_buckets: int) -> DataFrame:
    """doc_id, row_key, data: byte intervals to remove, as pairs of longs, some rows per document.

    ``keyed`` has doc_id, row_key and text; no id is null.
    """
    found = settled(
        keyed.mapInArrow(_span_rows(n_buckets), ROWS)
        .groupBy("bucket").applyInArrow(_meet_spans, RESULT)
    )
    aside = (
        found.where(F.col("kind") == ASIDE).groupBy("doc_id", "row_key")
        .agg(F.collect_list("data").alias("spans"))
    )
    windows = settled(
        keyed.join(aside, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "spans")
        .mapInArrow(_window_rows(n_buckets), ROWS)
        .groupBy("bucket").applyInArrow(_meet_windows, RESULT)
    )
    both = found.where(F.col("kind") == SETTLED).unionByName(windows)
    return both.select("doc_id", "row_key", "data")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row per document."""
    rows = id_and_text(docs)
    keyed = rows.withColumn("row_key", F.hash("doc_id", "text").cast("long"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(BUCKETS, -(-total // BUCKET_TEXT))
    known = keyed.where("doc_id is not null").select("doc_id", "row_key", "text")
    data = (
        intervals(known, n_buckets).groupBy("doc_id", "row_key")
        .agg(F.collect_set("data").alias("data"))  # rows that repeat id and text have the same
    )
    return (
        keyed.join(data, ["doc_id", "row_key"], "left").select("doc_id", "text", "data")
        .mapInArrow(_removed, DIGEST)
    )
