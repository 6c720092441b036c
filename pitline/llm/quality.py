"""Quality scores by positive-unlabelled learning.

Trusted positives (labelled good) and unlabelled web text are described by a few figures of their
form. The share of good text among the unlabelled, the class prior, is estimated from the positives
and all documents. A small model is then fitted by minimising the non-negative unbiased risk: the part
of the risk that stands for negatives is unlabelled loss minus prior times positive loss, and counts as
zero where it falls below. Labelled rows of either class then only place the cut between good and bad,
which is moved to ``THRESHOLD``.

Every document is unlabelled text. Its figures are written once; the standardisation, the tails and
the loss, gradient and curvature of the unlabelled are sums over all of them, one pass each, of which a
task returns only its sums. With a linear model and the logistic loss the risk is convex, so that
Newton's method needs few passes.

A document's figures use its text alone. Null or empty text: scored like any other, from figures that are all zero. A table
without positives gives the threshold everywhere. Repeated rows are scored once each; a null id counts as
not held out.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitline.llm.common import id_and_text, map_columns
from pitline.llm.learning import (
    LABELLED_ROWS,
    best_cut,
    fold,
    labelled_sample,
    newton,
    placed,
    sigmoid,
)
from pitline.session import materialize

THRESHOLD = 0.3
FOLDS = 5
#: Ridge of the model for the prior and of the model itself.
RIDGES = 1e-3, 1e-4
#: How near zero a binding part of the negatives is brought, and in how many tries at most.
BOUND, TRIES = 1e-5, 40

FIGURES = (
    "words", "mean_word", "marks", "capitals", "digits", "distinct", "doubled", "top_word",
    "repeated_lines", "line_words", "stops", "long_words",
)
#: Words of a piece; half of "distinct" is the mean share of distinct words in pieces, by their length.
PIECE = 200
MARK = re.compile(r"[^\w\s.,;:'’\"()?-]")
STOP = re.compile(r"[.?!](?:\s|$)")


def figures(text: str) -> list[float]:
    """Numbers between about 0 and 1 that describe the form of a text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FIGURES)
    chars = len(text)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    letters = sum(map(len, words))
    return [
        min(1.0, np.log1p(n) / 9),
        min(1.0, letters / n / 20),
        len(MARK.findall(text)) / chars,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isdigit, words)) / n,
        (sum(len(set(words[k : k + PIECE])) for k in range(0, n, PIECE)) + len(seen)) / n / 2,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        seen.most_common(1)[0][1] / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, n / max(1, len(lines)) / 200),
        min(1.0, len(STOP.findall(text)) / n * 4),
        sum(len(w) > 24 for w in words) / n,
    ]


def spread(x: np.ndarray) -> np.ndarray:
    """Figures and their square roots, which tell small shares apart, with a constant."""
    return np.hstack([x, np.sqrt(np.clip(x, 0, None)), np.ones((len(x), 1))])


class Model:
    """Weights on standardised figures and the cut that is moved to the threshold."""

    def __init__(self, centre, scale, weights, cut):
        self.centre, self.scale, self.weights, self.cut = centre, scale, weights, cut

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.prepared(x) @ self.weights)

    def prepared(self, x: np.ndarray) -> np.ndarray:
        z = spread(x)
        z[:, :-1] = np.clip((z[:, :-1] - self.centre) / self.scale, -8, 8)
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return placed(self.raw(x), self.cut, THRESHOLD)


class Rows:
    """Figures of documents held in memory."""

    def __init__(self, x: np.ndarray):
        self.x = x

    def sums(self, of) -> np.ndarray:
        """The sum over all documents of what ``of`` returns for some of them."""
        return of(self.x)


class Table:
    """Figures of documents in a table of any size."""

    def __init__(self, figures: DataFrame):
        self.rows = figures.select("x")

    def sums(self, of) -> np.ndarray:
        n = len(FIGURES)

        def run(batches):
            total = 0.0
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                total = total + of(x)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])

        got = self.rows.mapInArrow(run, "s array<double>").collect()
        return np.sum([r.s for r in got], axis=0) if got else of(np.zeros((0, n)))


def _prior(positive: np.ndarray, n: int, above) -> float:
    """``above`` returns how many of the ``n`` unlabelled scores are at or above each cut."""
    if not len(positive) or not n:
        return 0.5
    cuts = np.quantile(positive, np.linspace(0.0, 0.8, 33))
    tail_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    tail_u = above(cuts) / n
    noise = np.sqrt(1 / len(positive) + 1 / n) / 2
    return float(np.clip(np.min((tail_u + noise) / tail_p), 0.05, 0.98))


def count_above(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return (len(scores) - np.searchsorted(np.sort(scores), cuts)).astype(float)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of the two upper tails.

    Above a score at which hardly any negatives are left the ratio is the prior itself; tails that
    hold under a fifth of the positives are too noisy to count.
    """
    return _prior(positive, len(unlabelled), lambda cuts: count_above(unlabelled, cuts))


def _moments(source, n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scale over the ``n`` documents of ``source`` and the rows of ``x``."""
    n = max(1, n + len(x))
    plain = lambda x: spread(x)[:, :-1].sum(0)
    centre = (source.sums(plain) + plain(x)) / n
    square = lambda x: ((spread(x)[:, :-1] - centre) ** 2).sum(0)
    scale = np.sqrt((source.sums(square) + square(x)) / n)
    return centre, np.where(scale > 1e-9, scale, 1.0)


def _losses(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss when called negative, its gradient and its curvature, summed over rows and laid flat."""
    v = z @ w
    a = sigmoid(v)
    curve = (z * (a * (1 - a))[:, None]).T @ z
    return np.concatenate([[np.logaddexp(0, v).sum()], z.T @ a, curve.ravel()])


def _unflat(sums: np.ndarray, n: int):
    d = int(len(sums) ** 0.5)
    return sums[0] / n, sums[1 : d + 1] / n, sums[d + 1 :].reshape(d, d) / n


def fit(positive: np.ndarray, unlabelled) -> Model:
    """Minimise the non-negative risk of the logistic loss; ``unlabelled``: Rows, a Table or an array."""
    source = Rows(unlabelled) if isinstance(unlabelled, np.ndarray) else unlabelled
    n = int(source.sums(lambda x: np.array([float(len(x))]))[0])
    centre, scale = _moments(source, n, positive)
    model = Model(centre, scale, np.zeros(len(centre) + 1), 0.5)
    if not len(positive) or not n:
        return model
    p = model.prepared(positive)
    mean, eye = p.mean(0), np.eye(p.shape[1])

    def both(w):
        """Loss, gradient and curvature of either side called negative."""
        of = lambda x: _losses(model.prepared(x), w)
        return _unflat(_losses(p, w), len(p)), _unflat(source.sums(of), n)

    def plain(w):
        """Positives against unlabelled, for the prior only."""
        (pl, pg, ph), (ul, ug, uh) = both(w)
        r = RIDGES[0]
        return pl - mean @ w + ul + r / 2 * w @ w, pg - mean + ug + r * w, ph + uh + r * eye

    w = newton(plain, model.weights)
    prior = _prior(p @ w, n, lambda cuts: source.sums(lambda x: count_above(model.prepared(x) @ w, cuts)))

    def parts(w, share):
        """The part of the negatives with its gradient; the risk with ``share`` of it, as ``newton`` wants it."""
        (pl, pg, ph), (ul, ug, uh) = both(w)
        r, left = RIDGES[1], prior * (1 - share)
        return (ul - prior * pl, ug - prior * pg), (
            left * pl - prior * mean @ w + share * ul + r / 2 * w @ w,
            left * pg - prior * mean + share * ug + r * w,
            left * ph + share * uh + r * eye,
        )

    # The risk is convex for shares of 0 to 1, and max(0, part) is the largest share * part. So the least
    # risk is that of share 1 if the part isn't below zero there, else of the share that brings it to zero.
    w, share, low, high = np.zeros_like(w), 1.0, 0.0, 1.0
    for _ in range(TRIES):
        w = newton(lambda w: parts(w, share)[1], w)  # noqa: B023
        (part, gradient), (_, _, curve) = parts(w, share)
        if abs(part) < BOUND or part > 0 and share == 1:
            break
        low, high = (share, high) if part > 0 else (low, share)
        path = np.linalg.solve(curve, gradient)  # w moves against it as share grows
        better = share + part / (gradient @ path)
        better = better if low < better < high else (low + high) / 2
        w, share = w - (better - share) * path, better
    model.weights = w
    return model


def _figures_of():
    def work(ids, texts):
        return {"doc_id": ids, "x": [figures(t) for t in texts]}

    return work


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the figures of the whole text."""
    return map_columns(id_and_text(docs), _figures_of, "doc_id long, x array<double>")


def train(figures: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows of the training folds and all of ``described``."""
    known = labelled_sample(labels, "quality", fold(FOLDS) != 0, labelled_rows)
    # Rows that repeat an id count once, with the smallest figures, so the bound on ids bounds the rows.
    got = figures.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(
        F.min("x").alias("x")
    ).select("y", "x").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FIGURES))
    y = got["y"].to_numpy()
    model = fit(x[y == 1], Table(figures))
    if (y == 0).any():  # else the cut stays at even odds
        model.cut = best_cut(model.raw(x), y.astype(float))
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per document."""
    rows = materialize(described(docs))
    model = train(rows, labels)

    def make():
        def work(ids, x):
            s = model.score(np.array(x, dtype=float).reshape(-1, len(FIGURES)))
            return {"doc_id": ids, "score": s, "predicted": (s >= THRESHOLD).astype("int32")}

        return work

    scored = map_columns(rows, make, "doc_id long, score double, predicted int")
    return scored.select(
        "doc_id", F.coalesce(fold(FOLDS) == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )
