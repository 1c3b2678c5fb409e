"""k-step-ahead forecasts from the newest windows of each host."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, HORIZONS, SOURCE_WINDOWS_PER_HOST, Grid, Settings
from ..functions.rules import infer_stage, map_technique
from .labels import BENIGN, shift_target
from .metrics import alerts_at, auroc, classification, lead_summary, lead_times, threshold_at_fpr
from .sequences import newest_windows


def source_windows(rows: DataFrame, n: int = SOURCE_WINDOWS_PER_HOST) -> DataFrame:
    return newest_windows(rows, n)


def unavailable_horizons(wanted, heads: dict) -> dict[int, str]:
    """Every wanted horizon without a head, with its reason; none is dropped silently."""
    return {k: f"no head fitted for k={k}" for k in wanted if k not in heads}


def kstep_forecast(source: DataFrame, heads: dict[int, tuple[Column, float]],
                   settings: Settings = DEFAULTS) -> DataFrame:
    """One row per (host, source window, k): each horizon has its own score and threshold."""
    stride = float(settings.grid.stride_seconds)
    points = F.array(*[F.struct(
        F.lit(int(k)).alias("k"), F.lit(k * stride).alias("seconds_ahead"),
        score.alias("probability"), F.lit(float(threshold)).alias("threshold"),
        (score >= F.lit(float(threshold))).alias("alert")) for k, (score, threshold) in sorted(heads.items())])
    rows = source.withColumn("stage", infer_stage(settings.stage_rules))
    tech = map_technique("stage", settings.stage_rules, settings.techniques,
                         set(settings.feature_columns()) & set(source.columns))
    return rows.withColumn("technique", tech["technique"]).select(
        "host", "window_start", "stage", "technique", F.inline(points))


def _newest(forecast: DataFrame) -> DataFrame:
    # forecasts hold at most (source windows x horizons) rows per host
    newest = F.max("window_start").over(Window.partitionBy("host"))
    return forecast.withColumn("_newest", newest).filter("window_start = _newest").drop("_newest")


def per_host_curve(forecast: DataFrame) -> DataFrame:
    """Per host the newest source window's points in ascending k."""
    point = F.struct("k", "seconds_ahead", "probability", "alert")
    return _newest(forecast).groupBy("host").agg(F.array_sort(F.collect_list(point)).alias("points"))


def kstep_detail(curve: DataFrame, forecast: DataFrame, stride_seconds: int) -> DataFrame:
    """Curve points with threshold, stage and technique of the newest source window."""
    points = curve.select("host", F.inline("points"))
    detail = _newest(forecast).select("host", "k", "threshold", "stage", "technique")
    seconds = F.coalesce("seconds_ahead", F.col("k") * F.lit(float(stride_seconds)))
    return points.join(detail, ["host", "k"], "left").withColumn("seconds_ahead", seconds)


def kstep_hosts(forecast: DataFrame, top: int = 10) -> DataFrame:
    """Hosts by peak score of their curve; hosts without a readable score come last."""
    peak = _newest(forecast).groupBy("host").agg(F.max("probability").alias("peak"))
    return peak.orderBy(F.col("peak").desc_nulls_last(), "host").limit(top)


def horizon_table(scored: DataFrame, episodes: DataFrame, grid: Grid, budget: float,
                  horizons=HORIZONS, score: str = "score", fit_split: str = "val",
                  test_split: str = "test") -> DataFrame:
    """Per horizon: AUROC, confusion, lead time with grace k*stride, seconds ahead."""
    def at(k):
        rows = shift_target(scored, k).withColumn("y", (F.col("stage") != BENIGN).cast("int"))
        return rows.select(F.lit(int(k)).alias("k"), "split", "host", "window_id", "window_start", "y",
                           F.col(score).alias("score"))

    rows = reduce(DataFrame.unionByName, [at(k) for k in horizons])
    fitted = threshold_at_fpr(rows.filter(F.col("split") == fit_split), ["k"], (budget,))
    test = rows.filter(F.col("split") == test_split)
    points = classification(test, fitted, ["k"], ["k", "split"], ["budget"])
    area = auroc(test, ["k", "split"])
    fired = alerts_at(test, fitted, ["k"], ["budget"])
    leads = reduce(DataFrame.unionByName, [
        lead_summary(lead_times(fired.filter(F.col("k") == k), episodes,
                                points.filter(F.col("k") == k).select("k", "split"), grid, ["k"],
                                grace_seconds=k * grid.stride_seconds), ["k"]) for k in horizons])
    out = points.join(area, ["k", "split"]).join(leads, ["k", "split"], "left")
    return out.withColumn("seconds_ahead", F.col("k") * grid.stride_seconds)
