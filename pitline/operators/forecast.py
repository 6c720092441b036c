"""Training sets, leakage-safe splits and models of P(out-performing the median)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitline.functions.crosssection import average_rank, ordered_rank, quantiles
from pitline.operators.features import days
from pitline.session import materialize

REGIME = "regime_risk_on"


def training_set(
    matrix: DataFrame, regimes: DataFrame, horizon_days: int = 5
) -> DataFrame:
    """Label = forward return above the date's median; ``t0``/``t1`` bound the label's life.

    ``matrix`` carries the (possibly partial) forward return ``fwd``. Dates with one name go.
    """
    rows = matrix.where(F.col("fwd").isNotNull())
    sizes = rows.groupBy("as_of").agg(F.count(F.lit(1)).alias("_n"))
    stats = sizes.join(quantiles(rows, ["as_of"], "fwd", {"_median": 0.5}), "as_of")
    risk = regimes.select("as_of", F.col("risk_on").cast("double").alias(REGIME))
    return (
        rows.join(stats.where(F.col("_n") >= 2), "as_of")
        .join(risk, "as_of", "left")
        .withColumns(
            {
                "label": (F.col("fwd") > F.col("_median")).cast("double"),
                "t0": F.col("as_of"),
                "t1": F.col("as_of") + days(2 * horizon_days),
                REGIME: F.coalesce(F.col(REGIME), F.lit(1.0)),
            }
        )
        .drop("_median", "_n")
    )


def numbered(samples: DataFrame) -> DataFrame:
    """Samples with their position ``pos`` and the total ``n_samples`` in (t0, entity) order.

    Positions are counted per date and shifted by the dates before, so no task sorts everything.
    """
    per = samples.groupBy("t0").agg(F.count(F.lit(1)).alias("_c"))
    everything = W.partitionBy(F.lit(1))  # one row per date
    shifts = per.select(
        "t0",
        (F.sum("_c").over(everything.orderBy("t0")) - F.col("_c")).alias("_before"),
        F.sum("_c").over(everything).alias("n_samples"),
    )
    ranked = ordered_rank(
        samples.withColumn("_same", F.lit(0.0)), ["t0"], "_same", "entity_id", "_rank"
    )
    return ranked.join(shifts, "t0").withColumn(
        "pos", F.col("_rank") - 1 + F.col("_before")
    ).drop("_before", "_same", "_rank", "_rank_of")


def purged_folds(samples: DataFrame, n_splits: int = 5, embargo: float = 0.0) -> DataFrame:
    """``(fold, pos, is_test)`` of every sample that trains or tests in each fold.

    Folds are contiguous in position. A training sample whose label life touches the test span
    is dropped, and so are the ``embargo`` share of positions right after the test block.
    ``samples`` is the output of ``numbered``.
    """
    n = F.col("n_samples")
    big = n % n_splits
    size = F.floor(n / n_splits)
    # The first ``n % n_splits`` folds hold one sample more.
    in_big = F.col("pos") < big * (size + 1)
    fold = F.when(in_big, F.floor(F.col("pos") / (size + 1))).otherwise(
        big + F.floor((F.col("pos") - big * (size + 1)) / size)
    )
    placed = samples.withColumn("_own", fold.cast("int"))
    spans = placed.groupBy("_own").agg(
        F.min("t0").alias("_from"), F.max("t1").alias("_to"), F.max("pos").alias("_last"),
        F.max(F.bround(n * F.lit(float(embargo)))).alias("_gap"),
    )
    # At most ``n_splits`` rows: every sample meets all folds through one small array column.
    folds = spans.agg(
        F.collect_list(
            F.struct(F.col("_own").alias("fold"), "_from", "_to", "_last", "_gap")
        )
    ).scalar()
    each = placed.withColumn("_f", F.explode(folds))
    own = F.col("_own") == F.col("_f.fold")
    overlap = (F.col("t1") >= F.col("_f._from")) & (F.col("t0") <= F.col("_f._to"))
    held_back = (F.col("pos") > F.col("_f._last")) & (
        F.col("pos") <= F.col("_f._last") + F.col("_f._gap")
    )
    kept = each.where(own | (~overlap & ~held_back))
    rest = [c for c in samples.columns if c not in ("n_samples",)]
    return kept.select(F.col("_f.fold").alias("fold"), own.alias("is_test"), *rest)


def walk_forward(
    spark: SparkSession, n_samples: int, train: int, test: int, step: int | None = None,
    expanding: bool = False,
) -> DataFrame:
    """Windows ``(fold, train_from, train_to, test_from, test_to)`` by position, ends exclusive."""
    step = test if step is None else step
    if min(train, test, step) <= 0:
        raise ValueError("train, test and step must be positive")
    count = max(0, (n_samples - train - test) // step + 1)
    at = F.col("id") * step
    return spark.range(count).select(
        F.col("id").cast("int").alias("fold"),
        (F.lit(0) if expanding else at).cast("long").alias("train_from"),
        (at + train).alias("train_to"),
        (at + train).alias("test_from"),
        (at + train + test).alias("test_to"),
    )


# --- models ----------------------------------------------------------------------------------


def _prepare(names: Sequence[str]) -> list:
    filled = [f"{n}__filled" for n in names]
    return [
        Imputer(strategy="median", inputCols=list(names), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
    ]


def logistic(names: Sequence[str], reg: float | None = None) -> Pipeline:
    """Median imputation, standardisation, L2 logistic regression.

    Without ``reg`` the penalty follows from the number of rows, see ``fitted``.
    """
    penalty = {} if reg is None else {"regParam": reg}
    return Pipeline(
        stages=[
            *_prepare(names),
            StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
            LogisticRegression(maxIter=200, **penalty),
        ]
    )


def boosted_trees(names: Sequence[str], rounds: int = 200) -> Pipeline:
    """Shallow gradient-boosted trees."""
    return Pipeline(
        stages=[
            *_prepare(names),
            GBTClassifier(
                featuresCol="_raw", maxDepth=3, stepSize=0.05, maxIter=rounds, seed=0,
                maxMemoryInMB=256,
            ),
        ]
    )


def fitted(make: Callable[[], Pipeline], rows: DataFrame, c: float = 1.0):
    """Fit a pipeline; a logistic stage without a penalty gets 1 / (c n) for n rows, which is the
    strength ``c`` of the sum of the losses."""
    pipeline = make()
    for stage in pipeline.getStages():
        if isinstance(stage, LogisticRegression) and not stage.isSet(stage.regParam):
            stage.setRegParam(1.0 / (c * max(1, rows.count())))
    return pipeline.fit(rows)


def probabilities(model, rows: DataFrame, out: str = "probability") -> DataFrame:
    """P(label = 1) of a fitted pipeline; helper columns are removed."""
    scored = model.transform(rows)
    p = vector_to_array(F.col("probability"))[1]
    return scored.select(*rows.columns, p.alias("_p")).withColumnRenamed("_p", out)


def _fold_of(rows: DataFrame, folds: int) -> DataFrame:
    return rows.withColumn(
        "_cv", F.pmod(F.xxhash64("as_of", "entity_id"), F.lit(folds)).cast("int")
    )


def out_of_fold(
    make: Callable[[], Estimator], rows: DataFrame, folds: int, out: str
) -> DataFrame:
    """Probability of every row from a model that did not see it."""
    marked = materialize(_fold_of(rows, folds))
    parts = None
    for f in range(folds):
        model = fitted(make, marked.where(F.col("_cv") != f))
        scored = probabilities(model, marked.where(F.col("_cv") == f), out)
        parts = scored if parts is None else parts.unionByName(scored)
    return parts.drop("_cv")


class Stacked:
    """Logistic and boosted base models under a logistic meta-model fitted out of fold."""

    def __init__(self, names: Sequence[str], folds: int = 5, rounds: int = 200) -> None:
        self.names, self.folds, self.rounds = list(names), folds, rounds
        self.makers = {
            "_p_logit": lambda: logistic(self.names),
            "_p_gbt": lambda: boosted_trees(self.names, self.rounds),
        }

    def fit(self, rows: DataFrame) -> Stacked:
        rows = materialize(rows)
        stacked = rows
        for col, make in self.makers.items():
            stacked = out_of_fold(make, stacked, self.folds, col)
        self.base = {col: fitted(make, rows) for col, make in self.makers.items()}
        self.meta = fitted(lambda: logistic(list(self.makers)), materialize(stacked))
        return self

    def score(self, rows: DataFrame, out: str = "probability") -> DataFrame:
        scored = rows
        for col, model in self.base.items():
            scored = probabilities(model, scored, col)
        return probabilities(self.meta, scored, out).drop(*self.makers)


class Plain:
    """A single pipeline with the same interface as ``Stacked``."""

    def __init__(self, make: Callable[[], Estimator]) -> None:
        self.make = make

    def fit(self, rows: DataFrame) -> Plain:
        self.model = fitted(self.make, rows)
        return self

    def score(self, rows: DataFrame, out: str = "probability") -> DataFrame:
        return probabilities(self.model, rows, out)


class Calibrated:
    """Isotonic calibration on probabilities from held-out folds."""

    def __init__(self, make: Callable[[], Estimator], folds: int = 3) -> None:
        self.make, self.folds = make, folds

    def fit(self, rows: DataFrame) -> Calibrated:
        rows = materialize(rows)
        held = out_of_fold(self.make, rows, self.folds, "_raw_p")
        self.model = fitted(self.make, rows)
        self.curve = IsotonicRegression(featuresCol="_raw_p", labelCol="label").fit(held)
        return self

    def score(self, rows: DataFrame, out: str = "probability") -> DataFrame:
        raw = probabilities(self.model, rows, "_raw_p")
        return self.curve.transform(raw).withColumnRenamed("prediction", out).drop("_raw_p")


def momentum_baseline(samples: DataFrame, feature: str, out: str = "probability") -> DataFrame:
    """No-train baseline: rank of one feature over all samples scaled to (0, 1), ties by position.

    A missing value counts as the smallest one.
    """
    low = samples.agg(F.coalesce(F.min(feature), F.lit(0.0))).scalar()
    filled = samples.withColumn("_x", F.coalesce(F.col(feature), low)).withColumn(
        "_all", F.lit(1)
    ).withColumn(
        "_tie", F.concat_ws("|", F.date_format("as_of", "yyyyMMddHHmmss"), F.col("entity_id"))
    )
    ranked = ordered_rank(filled, ["_all"], "_x", "_tie", "_rank", descending=False)
    return ranked.withColumn(out, (F.col("_rank") - 0.5) / F.col("_rank_of")).drop(
        "_x", "_all", "_tie", "_rank", "_rank_of"
    )


def auc(scored: DataFrame, by: Sequence[str] = (), probability: str = "probability") -> DataFrame:
    """Exact area under the ROC curve per group from average ranks; null with one class only."""
    by = list(by)
    keyed = scored if by else scored.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    ranked = average_rank(keyed, keys, probability, "_r")
    pos = F.sum("label")
    n = F.count(F.lit(1))
    ranks = F.sum(F.when(F.col("label") == 1, F.col("_r")))
    u = ranks - pos * (pos + 1) / 2.0
    out = ranked.groupBy(*keys).agg(
        n.alias("n"), F.when((pos > 0) & (pos < n), u / (pos * (n - pos))).alias("auc")
    )
    return out.drop("_all")


def purged_cv_auc(
    samples: DataFrame, make: Callable[[], object], n_splits: int = 5, embargo: float = 0.02
) -> DataFrame:
    """Test AUC of each purged fold that has both classes in training and test."""
    folds = materialize(purged_folds(numbered(samples), n_splits, embargo))
    usable = [
        row["fold"]
        for row in folds.groupBy("fold")
        .agg(
            F.countDistinct(F.when(F.col("is_test"), F.col("label"))).alias("a"),
            F.countDistinct(F.when(~F.col("is_test"), F.col("label"))).alias("b"),
        )
        .where((F.col("a") == 2) & (F.col("b") == 2))
        .collect()  # one row per fold
    ]
    parts = None
    for f in sorted(usable):
        fold = folds.where(F.col("fold") == f)
        model = make().fit(fold.where(~F.col("is_test")))
        scored = model.score(fold.where(F.col("is_test"))).select(
            "fold", "label", "probability"
        )
        parts = scored if parts is None else parts.unionByName(scored)
    if parts is None:
        return samples.sparkSession.createDataFrame([], "fold int, n long, auc double")
    return auc(parts, ["fold"])
