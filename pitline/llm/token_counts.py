"""Token counts of whole texts, huge documents in overlapping chunks that are spliced exactly.

A chunk is encoded with offsets. Two neighbouring chunks share an overlap; they are cut at a
*stable boundary*, a position where every encoding of any text around it starts a new word. For
byte-level BPE that is a single space between two characters that are not white space: the word
pattern can take a space only at the start of a word, so no word spans the position, whatever stands
before or after it. Both encodings must show a token boundary there. If the overlap holds no such
position it is doubled, at last up to the rest of the document.

Texts up to ``HUGE_CHARS`` are counted whole. Those whose characters are all Latin are encoded with
the same vocabulary read as merge ranks, which gives the same tokens and takes a quarter of the
time; texts with other characters or with a special token's string use the named library.

Null or empty text: 0 bytes, 0 tokens. Repeated rows are counted once each; a null id stays null.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from pitline.llm.common import id_and_text, map_columns

HUGE_CHARS = 65_536
CHUNK = 16_384
OVERLAP = 128
LIMIT = 1024
#: A space with something other than white space on both sides.
STABLE = re.compile(r"(?<=\S) (?=\S)")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _boundary(starts: list[int], ends: list[int], p: int) -> int | None:
    """Number of tokens before the space at ``p``, or None if a token crosses it.

    Offsets may leave out a word's leading space, so the next token starts at p or p + 1.
    """
    import bisect

    k = bisect.bisect_left(starts, p)
    if k == len(starts) or starts[k] > p + 1 or (k and ends[k - 1] > p):
        return None
    return k


def spliced_count(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``; ``encode(part)`` returns the (start, end) offsets of its tokens."""
    total, begin = 0, 0
    while True:
        cut, width = begin + chunk, overlap
        if cut + width >= len(text):
            return total + len(encode(text[begin:]))
        while True:
            stop = min(len(text), cut + width)
            left = encode(text[begin:stop])
            right = encode(text[cut : stop + chunk])
            found = _splice(text, begin, cut, stop, left, right)
            if found:
                p, k = found
                total += k
                begin = p
                break
            if stop == len(text):
                return total + len(left)
            width *= 2


def _splice(text, begin, cut, stop, left, right):
    """The first stable boundary of the overlap on which both encodings agree."""
    a, b = [x for x, _ in left], [y for _, y in left]
    c, d = [x for x, _ in right], [y for _, y in right]
    for m in STABLE.finditer(text, cut + 1, max(cut + 1, stop - 1)):
        p = m.start()
        k = _boundary(a, b, p - begin)
        if k is not None and _boundary(c, d, p - cut) is not None:
            return p, k
    return None


def _counter(vocab: str, ranks: str, limit: int, huge: int):
    """Built once per task: a function from ids and texts to the output columns."""
    import base64
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(vocab))
    with open(public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
    quick = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
    )
    special = [t.content for t in library.get_added_tokens_decoder().values()]

    def count(text: str) -> int:
        if len(text) > huge:
            return spliced_count(text, lambda s: library.encode(s, add_special_tokens=False).offsets)
        if BEYOND_LATIN.search(text) or any(s in text for s in special):
            return len(library.encode(text, add_special_tokens=False).ids)
        return len(quick.encode_ordinary(text))

    def work(ids, texts):
        n = [count(t) for t in texts]
        return {
            "doc_id": ids,
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": n,
            "over_limit": [x > limit for x in n],
        }

    return work


def count_tokens(
    docs: DataFrame,
    vocab: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    limit: int = LIMIT,
    huge: int = HUGE_CHARS,
) -> DataFrame:
    """One row per document: its bytes, its tokens and whether they exceed ``limit``.

    ``vocab`` and ``ranks`` name the same public vocabulary in its two file forms.
    """
    return map_columns(id_and_text(docs), lambda: _counter(vocab, ranks, limit, huge), SCHEMA)
