"""Per-document operators against plain Python: main text, personal data, tokens, scores."""

import hashlib
import itertools
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitline.llm import html_text, pii, quality, token_counts, toxicity
from pitline.llm.learning import best_cut, placed

DOCS = "doc_id long, text string, lang string, score string, spans string"
ODD = [
    (1, None, "en", "x", "y"),
    (2, "", None, None, None),
    (None, "mail a.b@c.example now", "en", "x", "y"),
    (4, "word " * 40_000, "en", "x", "y"),
    (5, "card 4111 1111 1111 1111, tel +1 (469) 555-3334", "en", "x", "y"),
    (5, "card 4111 1111 1111 1111, tel +1 (469) 555-3334", "en", "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_html_blocks_and_classes(spark):
    pages = [
        (1, "u", "<nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>A<b>b</b>c\n d<br>e</p>"
         "<!-- no --><script>var x='<p>no</p>'</script></article><footer>&copy; me</footer>"),
        (2, None, None),
        (3, "u", ""),
        (4, "u", "<article><p>open <b>and cut off &am"),
        (4, "u", "<article><p>open <b>and cut off &am"),
        (None, "u", "plain text with no markup at all that goes on for a good number of words here"),
        (6, "u", "<div class='sidebar'>Side</div><main><p>Main</p><div id=comments><p>Hi</p></div></main>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df = df.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    got = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    want = sorted(
        [
            (1, "u", "T & U Abc d e", 13), (2, None, "", 0), (3, "u", "", 0),
            (4, "u", "open and cut off &am", 20), (4, "u", "open and cut off &am", 20),
            (None, "u", pages[5][2], len(pages[5][2])), (6, "u", "Main", 4),
        ],
        key=str,
    )
    assert got == want
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_tree_uses_links_of_block_and_neighbours():
    tree, used = html_text.grown(), set()

    def walk(t):
        if t.column is not None:
            used.add(html_text.FIGURES[t.column])
            walk(t.below)
            walk(t.above)

    walk(tree)
    assert {"words", "links", "links_before", "links_after"} <= used
    text = "Running text that goes on for quite a while, with many words and not one link in all of it."
    menu = "<div><a href=/1>Start</a> <a href=/2>All the news</a> <a href=/3>About us</a></div>"
    article = f"<article><p>{text}</p><p>Go.</p></article>"
    pages = {
        f"<div class='layout has-sidebar'>{article}</div>": f"{text} Go.",
        f"<div id='menu-page'><main><p>{text}</p><p>Go.</p></main></div>": f"{text} Go.",
        f"<form action=x>{article}</form>": f"{text} Go.",
        f"<div class='widget-content'><p>{text}</p></div>": text,
        f"<article><div class='post-header'><h1>Title</h1></div><p>{text}</p></article>": f"Title {text}",
        f"<div>{text}</div><div><a href='/m'>Menu</a></div>": text,
        f"<article><p title=it's>{text}</p></article>": text,
        f"<div class='siteFooter'>{text}</div>{article}<div class='cookie-box'>{text}</div>": f"{text} Go.",
        f"{article}<div class='comment-list'><article class='comment'>{text}</article></div>": f"{text} Go.",
        f"<nav>{article}</nav><header><p>{text}</p></header><p>{text}</p>": text,
        f"{menu}<div>Lines of this site</div>{menu}<h1>Head line</h1><div>{text}</div>{menu}": f"Head line {text}",
        f"<article>{menu}<p>Two</p>{menu}</article>": "Start All the news About us Two Start All the news About us",
    }
    for page, want in pages.items():
        assert html_text.extracted([page], tree) == [want], page
    lines = ["Yes", "No it is", "<a href=/a>Link</a>", "<a href=/b>Some more links</a>", text]
    for two in lines:  # whatever its lines and their neighbours, an article is taken whole
        for three in itertools.product(lines, repeat=2):
            inside = "".join(f"<p>{x}</p>" for x in (three[0], two, three[1]))
            want = re.sub(r"<[^>]*>", " ", inside).split()
            assert html_text.extracted([f"<article>{inside}</article>"], tree)[0].split() == want, inside
            around = f"{menu}<main>{inside}</main>{menu}"
            assert html_text.extracted([around], tree)[0].split() == want, inside
    long = f"<div>{text}</div>" * 20_000
    assert len(html_text.extracted([long], tree)[0]) == 20_000 * (len(text) + 1) - 1


def test_html_of_the_given_pages(spark, sf):
    import html as entities

    def plain(page):
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
        text = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|br|h1)>", " ", inner))
        return " ".join(entities.unescape(text).split())

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert got == {k: plain(v) for k, v in pages.items()}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if fits[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[1])))


def test_base_spans_match_the_patterns():
    random.seed(3)
    letters = "0123456789019..@@-+ ()ab%"
    for _ in range(20_000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 40)))
        base, every = pii.spans_of(text)
        assert base == brute_spans(text)
        assert set(base) <= set(every)


def test_checksums_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    kinds = lambda t: [k for _, k, _ in pii.spans_of(t)[1]]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 please") == ["iban"]
    assert kinds("ring 469-555-3334") == [] and kinds("phone 469-555-3334") == ["local_phone"]
    assert pii.redacted("to a.b@c.example, ok") == "to [email], ok"
    assert pii.redacted("1" * 50_000 + "@" * 50_000)  # linear on hostile texts


def test_ibans_need_their_checksum():
    found = lambda t: [t[a:b] for a, k, b in pii.spans_of(t)[1] if k == "iban"]
    gb, be = "GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034"
    assert found("bank account AB12 3456 7890 at the desk") == []
    assert found("iban GB82 WEST 1234 5698 7654 33, account") == []
    assert pii.redacted("account AB12 3456 7890") == "account AB12 3456 7890"
    assert found(f"account {be} CALL NOW") == [be] and found(f"bank {be} {gb}") == [be, gb]
    assert found(f"CODE AB12 {gb}") == [gb] and found(f"to {be.replace(' ', '')}.") == [be.replace(" ", "")]


def test_pii_rows(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        spans = brute_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(k == kind for _, k, _ in spans) for kind in PATTERNS
        )
    got = [tuple(r)[:5] for r in pii.find_pii(odd).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0), (None, 1, 0, 0, 0), (4, 0, 0, 0, 0), *[(5, 0, 0, 1, 1)] * 2],
        key=str,
    )
    assert pii.find_pii(none).count() == 0
    kept = pii.redact(odd)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 1


def test_token_counts(spark, sf, odd, none):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    offsets = lambda t: library.encode(t, add_special_tokens=False).offsets
    random.seed(1)
    parts = ["a", "the", " ", "  ", "\n", "12", " x", "'s", "é", "!", "<|endoftext|>", "　", "日本", "\xa0"]
    for _ in range(300):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 120)))
        assert token_counts.spliced_count(text, offsets, chunk=20, overlap=4) == len(offsets(text))
    odd_texts = spark.createDataFrame(
        [(i, "".join(random.choice(parts) for _ in range(80))) for i in range(200)], "doc_id long, text string"
    )
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_texts)
    for huge in (token_counts.HUGE_CHARS, 2_000):
        want = sorted((r.doc_id, len(r.text.encode()), len(offsets(r.text))) for r in docs.collect())
        got = token_counts.count_tokens(docs, huge=huge).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(odd).collect()}
    assert got[1] == got[2] == 0 and got[4] == len(offsets("word " * 40_000))
    assert token_counts.count_tokens(none).count() == 0


def held_out(labels, column, modulus, remainder):
    return {
        r.doc_id: r[column] for r in labels.collect()
        if zlib.crc32(str(r.doc_id).encode()) % modulus == remainder
    }


@pytest.mark.parametrize(
    "score, column, modulus, remainder, threshold, least",
    [
        (toxicity.score_toxicity, "toxic", 3, 1, 0.7, 0.95),
        (quality.score_quality, "quality", 5, 0, 0.3, 0.95),
    ],
)
def test_scores(spark, odd, none, score, column, modulus, remainder, threshold, least):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in score(docs.withColumn("y", F.lit(1)), labels).collect()}
    want = held_out(labels, column, modulus, remainder)
    assert sum(got[i].predicted == y for i, y in want.items()) / len(want) >= least
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == remainder)
    assert score(odd, labels).count() == len(ODD)
    assert score(odd, labels.limit(0)).count() == len(ODD)
    assert score(none, labels).count() == 0
    # Labels of the held-out fold don't matter.
    flipped = labels.withColumn(
        column,
        F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder,
               1 - F.col(column)).otherwise(F.col(column)),
    )
    assert {r.doc_id: r.score for r in score(docs, flipped).collect()} == pytest.approx(
        {i: r.score for i, r in got.items()}
    )


def test_automaton_against_edit_distance():
    random.seed(2)

    def near(a, b):
        """Edits between a and b, a swap of neighbours being one; no letter is edited twice."""
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(
                    d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1])
                )
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    terms = ["abcab", "abc", "bca", "cccc", "bacab", "ccccc", "abcabc", "abcabcab", "cabbacbba"]
    automaton = toxicity.Automaton(terms)
    for _ in range(4_000):
        word = "".join(random.choice("abc") for _ in range(random.randint(0, 11)))
        fits = [(d, t) for t in terms if (d := near(word, t)) <= toxicity.allowed_edits(t)]
        got = automaton.match(word)
        assert (got is None) == (not fits)
        if fits:
            assert got[1] == min(fits)[0] and got[0] in [t for d, t in fits if d == got[1]]
    words = toxicity.Automaton(["scum", "idiot", "basterds"])
    for word in "scvm scumm idioott basterrdd bastrds".split():
        assert (words.match(word) is None) == (word == "idioott"), word


def test_context_of_hits():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, {}, [])
    plain = lexicon.figures("so and so is an idiot they think")
    quoted = lexicon.figures('the term "idiot" was used there')
    direct = lexicon.figures("what an idiot you are, you idoit")
    assert quoted[0] < plain[0] < direct[0] + direct[2] and direct[2] > 0 and quoted[6] == 1
    assert sum(lexicon.figures("nothing here")[:7]) == 0


def test_cut_and_placing():
    import numpy as np

    s, y = np.array([0.1, 0.2, 0.6, 0.9]), np.array([0, 0, 1, 1])
    cut = best_cut(s, y)
    assert 0.2 < cut < 0.6
    moved = placed(s, cut, 0.7)
    assert (moved >= 0.7).tolist() == [False, False, True, True] and (np.diff(moved) > 0).all()


def test_class_prior_and_risk():
    import numpy as np

    rng = np.random.default_rng(0)
    good = lambda n: np.abs(rng.normal(0.2, 0.05, (n, len(quality.FIGURES))))
    bad = lambda n: np.abs(rng.normal(0.6, 0.05, (n, len(quality.FIGURES))))
    model = quality.fit(good(500), np.vstack([good(700), bad(300)]))
    assert model.raw(good(200)).min() > model.raw(bad(200)).max()
    p = rng.normal(2, 1, 2000)
    u = np.concatenate([rng.normal(2, 1, 1400), rng.normal(-2, 1, 600)])
    assert quality.class_prior(p, u) == pytest.approx(0.7, abs=0.06)


def test_quality_learns_from_all_documents(spark):
    """The unlabelled side is every document, in a table as in memory."""
    import numpy as np

    random.seed(8)
    words = "the rain came down on roofs and people stayed in their homes until noon".split()
    rows = []
    for i in range(46_000):
        text = " ".join(random.choice(words) for _ in range(random.randint(4, 12))) + "."
        rows.append((i, text if i % 4 else " ".join(text.upper().split()[:2] * 3) + " $$ 55 %"))
    rows += [(None, "no id at all"), (7, "a second row of one id"), (46_001, None)]
    marks = [(i, int(i % 4 > 0), 0) for i in range(0, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    x = np.array([quality.figures(t or "") for _, t in rows])
    known = np.array([i is not None and i < 3000 and zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows])
    y = np.array([(i or 0) % 4 > 0 for i, _ in rows], dtype=float)
    model = quality.fit(x[known & (y == 1)], x)
    model.cut = best_cut(model.raw(x[known]), y[known])
    got = sorted(((r.doc_id is None, r.doc_id), r.score) for r in quality.score_quality(docs, labels).collect())
    want = sorted(((i is None, i), s) for (i, _), s in zip(rows, model.score(x).tolist(), strict=True))
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)


def test_negative_part_of_the_risk_stays_above_zero():
    """The least non-negative risk, against the one of many plain steps down its gradient."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = len(quality.FIGURES)
    good = lambda k: np.abs(rng.normal(0.3, 0.1, (k, n)))
    p, u = good(300), np.vstack([good(600), np.abs(rng.normal(0.5, 0.1, (300, n)))])
    model = quality.fit(p, u)
    zp, zu = model.prepared(p) @ model.weights, model.prepared(u) @ model.weights
    w = model.weights
    base = quality.Model(model.centre, model.scale, w, 0.5)
    priors = []
    keep, quality._prior = quality._prior, lambda *a: priors.append(keep(*a)) or priors[-1]
    try:
        quality.fit(p, u)
    finally:
        quality._prior = keep
    part = np.logaddexp(0, zu).mean() - priors[0] * np.logaddexp(0, zp).mean()
    assert part > -1e-4

    def risk(w):
        a, b = base.prepared(p) @ w, base.prepared(u) @ w
        negative = np.logaddexp(0, b).mean() - priors[0] * np.logaddexp(0, a).mean()
        return priors[0] * np.logaddexp(0, -a).mean() + max(0, negative) + 0.5e-4 * w @ w

    least = risk(w)
    for _ in range(300):
        assert risk(w + rng.normal(0, 10 ** rng.uniform(-4, 0), len(w))) > least - 1e-5


def test_distinct_words_of_the_whole_text():
    at = quality.FIGURES.index("distinct")
    fresh = [f"w{k}" for k in range(200)]
    share = lambda words: quality.figures(" ".join(words))[at]
    assert share(fresh) == 1 and share(fresh[:50] * 2) == 0.5
    assert share(fresh + ["again"] * 200) == pytest.approx((201 / 400 + 201 / 400) / 2)
    assert share(["again"] * 200 + fresh) == share(fresh + ["again"] * 200)
    assert share(fresh * 3 + fresh[:50]) == pytest.approx((1 + 200 / 650) / 2)
