"""Model jobs on the shared feature matrix with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FPR_BUDGETS, HORIZONS, PACKET_FIELDS, SEED, Grid
from . import metrics as ME
from .labels import BENIGN, drop_family, shift_target

# Model settings.
LOGISTIC_C, LOGISTIC_ITER = 1.0, 500
TREES, DEPTH, RATE, SUBSAMPLE, COLUMNS = 300, 6, 0.1, 0.8, "0.8"

_FLAT = 1e-9              # relative deviation below which a feature is constant

Scaler = dict[str, tuple[float, float]]


def fit_scaler(train: DataFrame, features: list[str]) -> Scaler:
    """Mean and population deviation per feature (one aggregate row).

    A deviation that is zero up to rounding counts as 1.
    """
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features],
                    *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    out = {}
    for c in features:
        mean, dev = float(row[f"m_{c}"]), float(row[f"s_{c}"])
        out[c] = (mean, dev if dev > _FLAT * abs(mean) else 1.0)
    return out


def scaler_table(train: DataFrame, features: list[str]) -> DataFrame:
    """The scaler as (feature, mean, scale) rows."""
    stats = F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"),
                               F.stddev_pop(c).alias("scale")) for c in features])
    out = train.agg(stats.alias("s")).select(F.inline("s"))
    return out.withColumn("scale", F.when(F.col("scale") <= F.abs("mean") * _FLAT, 1.0).otherwise(F.col("scale")))


def z(feature: str, scaler: Scaler) -> Column:
    mean, scale = scaler[feature]
    return (F.col(feature) - F.lit(mean)) / F.lit(scale)


def apply_scaler(df: DataFrame, scaler: Scaler, flow_only: bool = False) -> DataFrame:
    """Scaled features; ``flow_only`` zeroes the packet statistics after scaling."""
    zero = set(PACKET_FIELDS) if flow_only else set()
    return df.select(*[
        c if c not in scaler else (F.lit(0.0) if c in zero else z(c, scaler)).alias(c) for c in df.columns])


def with_target(labelled: DataFrame, k: int = 0) -> DataFrame:
    """Binary target at k windows ahead."""
    return shift_target(labelled, k).withColumn("y", (F.col("stage") != BENIGN).cast("int"))


def assemble_split(labelled: DataFrame, split: str, features: list[str], k: int = 0, scaler: Scaler | None = None,
                   timeline: DataFrame | None = None, holdout: str | None = None,
                   flow_only: bool = False) -> tuple[DataFrame, Scaler]:
    """(scaled matrix, scaler) of one split; only train may fit the scaler."""
    rows = labelled.filter(F.col("split") == split)
    if holdout:
        rows = drop_family(rows, timeline, holdout)
    rows = with_target(rows, k)
    if scaler is None:
        if split != "train":
            raise ValueError("a scaler is fitted on the train split only")
        scaler = fit_scaler(rows, features)
    keep = ["split", "host", "window_id", "window_start", "stage", "y", *features]
    return apply_scaler(rows.select(*keep), scaler, flow_only), scaler


def class_weights(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Balanced class weights n / (2 n_c) and the positive weight neg / pos."""
    keys = keys or []
    pos, n = F.sum("y"), F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        n.alias("n"), (n / (2 * F.greatest(pos, F.lit(1)))).alias("w_attack"),
        (n / (2 * F.greatest(n - pos, F.lit(1)))).alias("w_benign"),
        ((n - pos) / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def _weighted(df: DataFrame, positive_only: bool = False) -> tuple[DataFrame, int]:
    w = class_weights(df).first()
    if positive_only:
        weight = F.when(F.col("y") == 1, F.lit(float(w["pos_weight"]))).otherwise(F.lit(1.0))
    else:
        weight = F.when(F.col("y") == 1, F.lit(float(w["w_attack"]))).otherwise(F.lit(float(w["w_benign"])))
    return df.withColumn("weight", weight), int(w["n"])


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def require_both_classes(df: DataFrame, what: str) -> None:
    row = df.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if row["lo"] is None or row["lo"] == row["hi"]:
        raise ValueError(f"{what}: rows are single-class")


def fit_logistic(train: DataFrame, features: list[str], c: float = LOGISTIC_C, max_iter: int = LOGISTIC_ITER) -> Model:
    """Class-balanced L2 logistic regression."""
    rows, n = _weighted(train)
    est = LogisticRegression(labelCol="y", weightCol="weight", regParam=1.0 / (c * max(n, 1)), maxIter=max_iter,
                             standardization=False)
    return est.fit(_vectors(rows, features))


def fit_boosted_trees(train: DataFrame, features: list[str], trees: int = TREES, depth: int = DEPTH,
                      rate: float = RATE, seed: int = SEED) -> Model:
    """Boosted trees with imbalance weights and row / column subsampling."""
    rows, _ = _weighted(train, positive_only=True)
    est = GBTClassifier(labelCol="y", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate,
                        subsamplingRate=SUBSAMPLE, featureSubsetStrategy=COLUMNS, seed=seed)
    return est.fit(_vectors(rows, features))


# Registry of model constructors by name.
MODELS: dict[str, Callable[..., Model]] = {"logistic": fit_logistic, "trees": fit_boosted_trees}


def score(model: Model, df: DataFrame, features: list[str], name: str = "score") -> DataFrame:
    """P(attack) per row."""
    out = model.transform(_vectors(df, features))
    drop = [c for c in ("features", "rawPrediction", "probability", "prediction", "weight") if c in out.columns]
    return out.withColumn(name, vector_to_array("probability")[1]).drop(*drop)


def train_and_score(labelled: DataFrame, features: list[str], model: str = "logistic", k: int = 0,
                    timeline: DataFrame | None = None, holdout: str | None = None, flow_only: bool = False,
                    name: str | None = None, **params) -> DataFrame:
    """Train on train, score val and test: rows in the score store's schema."""
    train, scaler = assemble_split(labelled, "train", features, k, timeline=timeline, holdout=holdout,
                                   flow_only=flow_only)
    require_both_classes(train, f"train split at k={k}")
    fitted = MODELS[model](train, features, **params)
    parts = [assemble_split(labelled, s, features, k, scaler, flow_only=flow_only)[0] for s in ("val", "test")]
    out = score(fitted, reduce(DataFrame.unionByName, parts), features)
    return out.select(F.lit(name or model).alias("model"), "split", "host", "window_id", "window_start", "y", "score")


def fit_horizon_heads(labelled: DataFrame, features: list[str], grid: Grid, horizons: Iterable[int] = (0, *HORIZONS),
                      budgets=FPR_BUDGETS, model: str = "trees", cut: Callable[[DataFrame], DataFrame] = lambda df: df,
                      **params) -> tuple[dict, DataFrame]:
    """One head per (variant, k) with its own thresholds and val AUROC.

    The flow variant is trained with the packet statistics masked, as it is served.
    Returns the fitted models and the threshold table (variant, k, budget, threshold).
    ``cut`` (write and read back) makes the rows of a horizon once, for both variants and every pass over them.
    """
    heads, tables = {}, []
    _, scaler = assemble_split(labelled, "train", features)
    for k in horizons:
        full = [cut(assemble_split(labelled, s, features, k, scaler)[0]) for s in ("train", "val")]
        for variant in ("full", "flow"):
            train, val = full if variant == "full" else [
                rows.withColumns({c: F.lit(0.0) for c in features if c in PACKET_FIELDS}) for rows in full]
            for name, rows in (("train", train), ("val", val)):
                require_both_classes(rows, f"k={k} {name} split")
            heads[variant, k] = MODELS[model](train, features, **params)
            scored = score(heads[variant, k], val, features).withColumn("variant", F.lit(variant)).withColumn(
                "k", F.lit(int(k)))
            keys = ["variant", "k"]
            tables.append(ME.threshold_at_fpr(scored, keys, budgets).drop("n_false").join(
                ME.auroc(scored, keys).select(*keys, F.col("auroc").alias("val_auroc")), keys))
    out = reduce(DataFrame.unionByName, tables)
    return heads, out.withColumn("seconds_ahead", F.col("k") * grid.stride_seconds)


def head_on_snapshot(rows: DataFrame, features: list[str], n_benign: int, seed=SEED) -> Model:
    """Linear head on host-state snapshots: all attack rows and a seeded benign sample."""
    attack = rows.filter("y = 1")
    benign = ME.hash_order(rows.filter("y = 0"), [], seed, ["host", "window_id"]).filter(
        F.col("row_no") <= n_benign).drop("row_no")
    return fit_logistic(attack.unionByName(benign), features)


def isotonic_calibrate(rows: DataFrame, column: str = "score", fit_split: str = "val",
                       name: str = "probability") -> DataFrame:
    """Monotone calibration fitted on one split, clipped outside; never used for thresholds.

    The fit ends in one pass over what it is given: one weighted row per distinct score, not per window.
    """
    est = IsotonicRegression(featuresCol=column, labelCol="y", predictionCol=name, weightCol="weight")
    per_score = rows.filter(F.col("split") == fit_split).groupBy(column).agg(
        F.avg(F.col("y").cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("weight"))
    return est.fit(per_score).transform(rows)


def fuse_stack(rows: DataFrame, members: list[str], fit_split: str = "val", name: str = "score") -> DataFrame:
    """Logistic stack of member scores, fitted on one split."""
    model = fit_logistic(rows.filter(F.col("split") == fit_split), members, max_iter=1000)
    return score(model, rows, members, name)


def explain_linear(rows: DataFrame, coefficients: dict[str, float], scaler: Scaler, k: int = 5) -> DataFrame:
    """Top-k signed contributions coef * z per row, one output row per (row, feature)."""
    items = F.array(*[F.struct(
        (-F.abs(F.lit(w) * z(f, scaler))).alias("order"), F.lit(f).alias("feature"),
        z(f, scaler).alias("value"), (F.lit(w) * z(f, scaler)).alias("contribution")) for f, w in coefficients.items()])
    return _ranked(rows, items, k)


def explain_occlusion(model: Model, scaled: DataFrame, features: list[str], k: int = 5) -> DataFrame:
    """Top-k features by score change when the feature is set to its train mean (scaled 0).

    One more scored column per feature on the same row: no copies, no shuffle.
    """
    out = score(model, scaled, features, "_full").withColumn("_mean", F.lit(0.0))
    for i, f in enumerate(features):
        out = score(model, out, ["_mean" if c == f else c for c in features], f"_without_{i}")
    items = F.array(*[F.struct(
        (-F.abs(F.col("_full") - F.col(f"_without_{i}"))).alias("order"), F.lit(f).alias("feature"),
        F.col(f).cast("double").alias("value"), (F.col("_full") - F.col(f"_without_{i}")).alias("contribution"))
        for i, f in enumerate(features)])
    return _ranked(out, items, k)


def _ranked(rows: DataFrame, items: Column, k: int) -> DataFrame:
    top = F.slice(F.array_sort(items), 1, k)
    return rows.select("host", "window_start", F.posexplode(top).alias("pos", "i")).select(
        "host", "window_start", (F.col("pos") + 1).alias("rank"), "i.feature", "i.value", "i.contribution")


def feature_ablation(labelled: DataFrame, features: list[str], drop: list[str], episodes: DataFrame, grid: Grid,
                     model: str = "logistic", budgets=FPR_BUDGETS, **params) -> DataFrame:
    """Evaluation rows with the full feature set and with each feature left out."""
    arms = [("all", features), *[(f"without_{f}", [c for c in features if c != f]) for f in drop]]
    scores = reduce(DataFrame.unionByName, [
        train_and_score(labelled, cols, model, name=name, **params) for name, cols in arms])
    return ME.evaluate(scores, episodes, grid, budgets)


def split_comparison(labelled: DataFrame, features: list[str], n_shuffles: int, seed: int = SEED,
                     test_splits=("test",), train_splits=("train",),
                     cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Day-disjoint AUROC beside random splits of the same size and the same model.

    ``cut`` (write and read back) makes the pool and every drawn order once, not in each pass of an arm.
    """
    if n_shuffles < 1:
        raise ValueError("n_shuffles must be >= 1")
    pool = cut(with_target(labelled.filter(F.col("split").isin([*train_splits, *test_splits]))).select(
        "split", "host", "window_id", "y", *features))
    held = F.col("split").isin(list(test_splits))
    n_test = pool.filter(held).count()

    def arm(name, shuffle, train, test):
        require_both_classes(test, f"{name} test rows")
        require_both_classes(train, f"{name} train rows")
        scaler = fit_scaler(train, features)
        fitted = fit_logistic(apply_scaler(train, scaler), features)
        scored = score(fitted, apply_scaler(test, scaler), features)
        return ME.auroc(scored.withColumn("arm", F.lit(name)).withColumn("shuffle", F.lit(shuffle)), ["arm", "shuffle"])

    out = arm("disjoint", 0, pool.filter(~held), pool.filter(held))
    for i in range(1, n_shuffles + 1):
        drawn = cut(ME.hash_order(pool, [], f"{seed}:{i}", ["host", "window_id"]))
        out = out.unionByName(arm("random", i, drawn.filter(F.col("row_no") > n_test), drawn.filter(F.col("row_no") <= n_test)))
    return out


def inflation(comparison: DataFrame) -> DataFrame:
    """Median, min and max AUROC per arm, and how far random exceeds disjoint."""
    per = comparison.groupBy("arm").agg(F.percentile("auroc", F.lit(0.5)).alias("median"),
                                        F.min("auroc").alias("low"), F.max("auroc").alias("high"))
    pick = lambda a: F.max(F.when(F.col("arm") == a, F.col("median")))
    gap = per.agg((pick("random") - pick("disjoint"))).scalar()
    return per.withColumn("inflation", gap)
