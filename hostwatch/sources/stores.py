"""Parquet and JSON stores: features, scores, alerts, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DYNAMIC = ("partitionOverwriteMode", "dynamic")


def write_features(df: DataFrame, path: str, keys=("day", "capture_id")) -> None:
    """Per-day, per-capture partitions; re-running a capture replaces only its own."""
    df.write.mode("overwrite").option(*DYNAMIC).partitionBy(*keys).parquet(path)


def missing_captures(wanted: DataFrame, spark: SparkSession, path: str, keys=("day", "capture_id")) -> DataFrame:
    """Captures without output yet, so a resumed run skips what exists."""
    return wanted.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")


def read_features(spark: SparkSession, path: str, days=None) -> DataFrame:
    """Partition-pruned read of ``days`` (default: all there are); a named day without any rows raises."""
    df = spark.read.option("inferSchema", "false").parquet(path).withColumn("day", F.col("day").cast("string"))
    if days is None:
        return df
    days = [str(d) for d in days]
    df = df.filter(F.col("day").isin(days))
    have = {r[0] for r in df.select("day").distinct().collect()}  # at most len(days) values
    absent = [d for d in days if d not in have]
    if absent:
        raise FileNotFoundError(f"no extracted features for {absent} under {path}")
    return df


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").option(*DYNAMIC).partitionBy("model", "split").parquet(path)


def read_scores(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if model is None else df.filter(F.col("model") == model)


def write_alerts(alerts: DataFrame, summary: DataFrame, path: str) -> None:
    """Alert objects plus the one-row run summary, written also for zero alerts."""
    alerts.write.mode("overwrite").json(f"{path}/alerts")
    summary.write.mode("overwrite").json(f"{path}/run_summary")


def read_results(spark: SparkSession, path: str, require=("test",), multi_line: bool = True) -> DataFrame:
    """Result files: experiments ('__' in the name) and files without the required
    blocks are left out; one row per (model, holdout), first file wins."""
    df = spark.read.option("multiLine", str(multi_line).lower()).json(path).withColumn("_file", F.col("_metadata.file_path"))
    if "holdout_family" not in df.columns:
        df = df.withColumn("holdout_family", F.lit(None).cast("string"))
    for block in require:
        df = df.filter(F.col(block).isNotNull() if block in df.columns else F.lit(False))
    df = df.filter(~F.col("model").contains("__"))
    first = F.row_number().over(Window.partitionBy("model", "holdout_family").orderBy("_file"))
    return df.withColumn("_n", first).filter("_n = 1").drop("_n", "_file")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions below ``path``: folders whose writing has ended."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [f.getPath() for f in files.listStatus(folder)]
    whole = [n.getName() for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(n, "thresholds/_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in whole if n.startswith("version="))


def write_heads(heads: dict, thresholds: DataFrame, path: str) -> int:
    """Write fitted heads, named (variant, k), and their thresholds as a new version; returns its number.

    The threshold table is written last: a version without it was broken off and is not seen by readers.
    """
    spark = thresholds.sparkSession
    version = max(_versions(spark, path), default=0) + 1
    for (variant, k), model in heads.items():
        model.write().overwrite().save(f"{path}/version={version}/heads/{variant}-{k}")
    thresholds.write.mode("overwrite").parquet(f"{path}/version={version}/thresholds")
    return version


def read_thresholds(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Thresholds (variant, k, budget, threshold, ...) of a version, the last one if none is named."""
    known = _versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {version if version is not None else ''} of heads under {path}; have {known}")
    return spark.read.parquet(f"{path}/version={version or known[-1]}/thresholds")


def read_head(spark: SparkSession, path: str, variant: str, k: int, version: int | None = None):
    """The fitted head of (variant, k)."""
    from pyspark.ml.util import DefaultParamsReader
    known = read_thresholds(spark, path, version).select("variant", "k").distinct().collect()
    if (variant, k) not in {(r["variant"], r["k"]) for r in known}:
        raise KeyError(f"no head for {variant}/{k}; have {sorted((r['variant'], r['k']) for r in known)}")
    number = version or _versions(spark, path)[-1]
    return DefaultParamsReader.loadParamsInstance(f"{path}/version={number}/heads/{variant}-{k}", spark.sparkContext)


def threshold_for(spark: SparkSession, path: str, variant: str, k: int, budget: float, version: int | None = None) -> float:
    """The threshold of one (variant, horizon, budget); a key without one raises, nothing stands in for it."""
    table = read_thresholds(spark, path, version)
    found = table.filter((F.col("variant") == variant) & (F.col("k") == k) & (F.col("budget") == budget)).select("threshold").limit(2).collect()
    if len(found) != 1:
        known = table.select("variant", "k", "budget").distinct().limit(50).collect()
        raise KeyError(f"no threshold for {variant}/{k}/{budget}; have {sorted(tuple(r) for r in known)}")
    return found[0]["threshold"]
