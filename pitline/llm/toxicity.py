"""Toxicity scores from a lexicon, misspellings included, with the context of each hit.

The lexicon is learned from labelled documents: words far more frequent in toxic ones, and stems
that several such words share. It is stored as a trie. A word is matched by walking the trie together with a Levenshtein automaton; the pairs of
trie node and automaton state reached so far form one state of a deterministic automaton, which is
built only as far as words lead into it. Most words die after two or three letters.

Each hit gets a weight from the words around it: quotation marks and reporting words lower it
(quotation), address words and further hits raise it (abuse). The sums of a document feed a logistic
model, and a rising map moves its best cut to ``THRESHOLD``.

Null or empty text: no hits, a low score. Without toxic labels every score is low. Repeated rows are
scored once each; a null id counts as not held out.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.llm.common import id_and_text, map_columns
from pitline.llm.learning import (
    LABELLED_ROWS,
    adam,
    best_cut,
    fold,
    labelled_sample,
    placed,
    sigmoid,
    standardised,
)
from pitline.session import materialize

THRESHOLD = 0.7
FOLDS = 3
#: Lexicon: what a term needs: lift of the toxic documents over the others, and evidence, the
#: log-likelihood ratio of its counts. Only the number of labelled rows bounds how many get there.
LIFT, EVIDENCE = 10.0, 12.0
#: Stems: lengths, words that start with one, evidence over all of them.
STEMS, STEM_WORDS, STEM_EVIDENCE = (5, 8), 4, 20.0
#: Terms are matched within one edit from so many letters on, and within two edits.
FUZZY_LENGTHS = (4, 8)
CONTEXT_WORDS = 8
WORD = re.compile(r"[^\W_]+")
QUOTES = frozenset("\"“”„«»‹›‘’`")
REPORTING = frozenset(
    "said says quote quoted called term word phrase reported wrote alleged slur example".split()
)
ADDRESS = frozenset("you your youre u ur du dich dein tu toi te vous tú usted eres".split())
FIGURES = ("exact", "stem", "fuzzy", "terms", "density", "direct", "quoted", "words")


def allowed_edits(term: str) -> int:
    return sum(len(term) >= n for n in FUZZY_LENGTHS)


class Automaton:
    """Words within the allowed edits of a lexicon term, as a lazily determinised product.

    A state is the set of (trie node, edits so far, letter owed) triples after the letters read; a
    swap of two neighbouring letters counts as one edit, and owes its second letter in between.
    """

    def __init__(self, terms):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.budget: list[int] = [0]  # the most edits that a term below a node allows
        for t in sorted(terms):
            node, allowed = 0, allowed_edits(t)
            self.budget[0] = max(self.budget[0], allowed)
            for ch in t:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.budget.append(0)
                node = self.children[node][ch]
                self.budget[node] = max(self.budget[node], allowed)
            self.term[node] = t
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._add(self._closure({(0, 0, "")}))

    def _closure(self, triples):
        """Add the triples reached by skipping letters of a term."""
        out, new = set(triples), list(triples)
        while new:
            node, edits, owed = new.pop()
            for c in self.children[node].values() if not owed else ():
                to = (c, edits + 1, "")
                if edits < self.budget[c] and to not in out:
                    out.add(to)
                    new.append(to)
        return frozenset(out)

    def _add(self, state: frozenset) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            ends = [
                (e, self.term[n])
                for n, e, owed in state
                if not owed and self.term[n] and e <= allowed_edits(self.term[n])
            ]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.number[state]

    def _step(self, at: int, ch: str) -> int:
        out = set()
        for node, edits, owed in self.states[at]:
            if owed:  # second letter of a swap
                if ch == owed:
                    out.add((node, edits, ""))
                continue
            nxt = self.children[node].get(ch)
            if nxt is not None and edits <= self.budget[nxt]:
                out.add((nxt, edits, ""))
            if edits < self.budget[node]:
                out.add((node, edits + 1, ""))  # a letter too many
                for first, c in self.children[node].items():
                    if edits < self.budget[c]:
                        out.add((c, edits + 1, ""))  # a wrong letter
                        after = self.children[c].get(ch)
                        if after is not None and edits < self.budget[after]:
                            out.add((after, edits + 1, first))  # two letters swapped
        to = self._add(self._closure(out)) if out else -1
        if len(self.moves[at]) < 4096:
            self.moves[at][ch] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the closest term within its budget, or None."""
        at = self.start
        for ch in word:
            nxt = self.moves[at].get(ch)
            at = self._step(at, ch) if nxt is None else nxt
            if at < 0:
                return None
        return self.accepts[at]


class Lexicon:
    """Terms and stems with their log lifts, and words not to be taken for misspellings."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], harmless):
        self.terms, self.stems, self.harmless = terms, stems, frozenset(harmless)
        self.automaton = Automaton(terms)

    def match(self, word: str):
        """(kind, term, weight) or None; kinds: 0 the term itself, 1 its stem, 2 a misspelling."""
        got = self.automaton.match(word)
        if got and not got[1]:
            return 0, got[0], self.terms[got[0]]
        for k in range(min(len(word), STEMS[1]), STEMS[0] - 1, -1):
            if word[:k] in self.stems:
                return 1, word[:k], self.stems[word[:k]]
        if got and word not in self.harmless:
            return 2, got[0], self.terms[got[0]]
        return None

    def figures(self, text: str) -> list[float]:
        """Weights of the three kinds, distinct terms, density, shares in direct address and in
        quotation, length."""
        low = text.lower()
        words = WORD.findall(low)
        n = len(words)
        found = {w: m for w in set(words) if (m := self.match(w))}
        if not found:
            return [0.0] * (len(FIGURES) - 1) + [float(np.log1p(n))]
        spans = [m.span() for m in WORD.finditer(low)]
        hits = [i for i, w in enumerate(words) if w in found]
        weight, direct, quoted = [0.0, 0.0, 0.0], 0, 0
        for k, i in enumerate(hits):
            a, b = max(0, i - CONTEXT_WORDS), min(n, i + CONTEXT_WORDS + 1)
            near = words[a:b]
            left, right = low[spans[a][0] : spans[i][0]], low[spans[i][1] : spans[b - 1][1] + 1]
            in_quotes = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
            reported = any(w in REPORTING for w in near)
            address = any(w in ADDRESS for w in near)
            close = (k > 0 and i - hits[k - 1] <= CONTEXT_WORDS) + (
                k + 1 < len(hits) and hits[k + 1] - i <= CONTEXT_WORDS
            )
            kind, _, lift = found[words[i]]
            w = lift / 5 * (0.3 if in_quotes else 1) * (0.6 if reported else 1)
            weight[kind] += w * (1 + 0.25 * address + 0.1 * close)
            direct += address
            quoted += in_quotes or reported
        return [
            *(float(np.log1p(w)) for w in weight),
            float(np.log1p(len({m[1] for m in found.values()}))),
            float(np.sqrt(sum(weight) / n)),
            direct / len(hits),
            quoted / len(hits),
            float(np.log1p(n)),
        ]


class Model:
    def __init__(self, lexicon, centre, scale, weights, cut):
        self.lexicon, self.centre, self.scale = lexicon, centre, scale
        self.weights, self.cut = weights, cut

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return sigmoid(np.hstack([z, np.ones((len(z), 1))]) @ self.weights)

    def score(self, texts) -> np.ndarray:
        x = np.array([self.lexicon.figures(t) for t in texts]).reshape(-1, len(FIGURES))
        return np.clip(placed(self.raw(x), self.cut, THRESHOLD), 0.0, 1.0)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms of the labelled texts (doc_id, text, y), and near misses of terms that are harmless.

    Exact copies count once. The words stay in Spark; only the terms and stems with enough evidence
    come back, and of the other words only those the automaton takes for a misspelling. All of them
    are words of the labelled sample, so its bound bounds them too.
    """
    once = sample.dropDuplicates(["text"])
    words = once.select(
        "y", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")
    ).where(F.length("word") >= 3)
    totals = once.agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = int(totals["toxic"] or 0), int(totals["n"] - (totals["toxic"] or 0))
    if not toxic or not clean:
        return Lexicon({}, {}, [])
    counts = materialize(
        words.groupBy("word").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("every"))
    )

    def judged(df: DataFrame) -> DataFrame:
        bad, good = F.col("bad"), F.col("every") - F.col("bad")
        share = F.lit(toxic / (toxic + clean))
        part = lambda n, q: F.when(n > 0, n * F.log(n / (F.col("every") * q))).otherwise(0.0)
        return df.withColumns(
            {
                "lift": (bad / toxic) / ((good + 0.5) / clean),
                "evidence": part(bad, share) + part(good, 1 - share),
            }
        )

    def best(df: DataFrame, evidence: float) -> dict[str, float]:
        rows = df.where((F.col("lift") >= LIFT) & (F.col("evidence") >= evidence))
        return {r["word"]: float(np.log(r["lift"])) for r in rows.select("word", "lift").collect()}

    alone = judged(counts)
    terms = best(alone, EVIDENCE)
    low, high = STEMS
    stems = (
        counts.where(F.length("word") > low)
        .withColumn("k", F.explode(F.expr(f"sequence({low}, least({high}, length(word) - 1))")))
        .groupBy(F.expr("substring(word, 1, k)").alias("word"))
        .agg(
            F.sum("bad").alias("bad"),
            F.sum("every").alias("every"),
            F.count(F.when(F.col("bad") > 0, 1)).alias("words"),
        )
        .where(F.col("words") >= STEM_WORDS)
    )
    stem_terms = best(judged(stems), STEM_EVIDENCE)
    automaton = Automaton(terms)

    @F.udf("boolean")
    def near_miss(word):
        got = automaton.match(word)
        return got is not None and got[1] > 0

    usual = alone.where((F.col("every") - F.col("bad") >= 2) & (F.col("lift") < LIFT)).where(
        near_miss("word")
    )
    return Lexicon(terms, stem_terms, [r["word"] for r in usual.select("word").collect()])


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    known = labelled_sample(labels, "toxic", fold(FOLDS) != 1, labelled_rows)
    # Of rows that repeat an id one counts, by a hash of the text, so the bound on ids bounds the rows.
    one = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    sample = materialize(
        docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(one)
    )
    lexicon = learn_lexicon(sample)

    def make():
        def work(ys, texts):
            return {"y": ys, "x": [lexicon.figures(t) for t in texts]}

        return work

    got = map_columns(sample.select("y", "text"), make, "y int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FIGURES))
    y = got["y"].to_numpy(dtype=float)
    size = len(FIGURES) + 1
    if len(y) == 0 or y.min() == y.max() or not lexicon.automaton.children[0]:
        weights = np.append(np.zeros(size - 1), -3.0)
        return Model(lexicon, np.zeros(size - 1), np.ones(size - 1), weights, 0.5)
    centre, scale = standardised(x)
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])

    def gradient(w):
        return z.T @ (sigmoid(z @ w) - y) / len(y) + 1e-3 * np.append(w[:-1], 0)

    weights = adam(gradient, size, 1500, 0.05)
    model = Model(lexicon, centre, scale, weights, 0.5)
    model.cut = best_cut(model.raw(x), y)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of (doc_id, text) rows."""

    def make():
        def work(ids, texts):
            s = model.score(texts)
            return {"doc_id": ids, "score": s, "predicted": (s >= THRESHOLD).astype("int32")}

        return work

    return map_columns(docs, make, "doc_id long, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per document."""
    rows = id_and_text(docs)
    return score_texts(rows, train(rows, labels)).select(
        "doc_id", F.coalesce(fold(FOLDS) == 1, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns; the text is scored."""
    model = train(id_and_text(docs), labels)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.fillna("")) < THRESHOLD)

    return docs.where(clean(F.col("text").cast("string")))
