"""Combining member scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import average_ranks
from .ordered import cumulative, per_key


def align_scores(a: DataFrame, b: DataFrame, keys=("split", "host", "window_id")) -> DataFrame:
    """Join two members' scores; unmatched rows or different labels fail the query."""
    keys = list(keys)
    left = a.select(*keys, F.col("y").alias("y"), F.col("score").alias("score_a"))
    right = b.select(*keys, F.col("y").alias("_yb"), F.col("score").alias("score_b"))
    both = left.join(right, keys, "full_outer")
    same = F.coalesce(F.col("y") == F.col("_yb"), F.lit(False))
    guard = F.when(same, F.col("y")).otherwise(
        F.raise_error(F.lit("members disagree on rows or labels")).cast("int"))
    return both.withColumn("y", guard).drop("_yb")


def fuse_mean(rows: DataFrame, members: list[str], name: str = "score") -> DataFrame:
    total = sum((F.col(m) for m in members[1:]), F.col(members[0]))
    return rows.withColumn(name, total / F.lit(len(members)))


def rank_fusion(rows: DataFrame, members: list[str], keys=("split",), name: str = "score") -> DataFrame:
    """Mean of within-split rank percentiles (transductive: needs the whole split)."""
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    out = rows
    for m in members:
        out = average_ranks(out, keys, m, f"_rank_{m}")
    out = out.join(per_key(sizes), keys)
    for m in members:
        out = out.withColumn(f"_pct_{m}", F.col(f"_rank_{m}") / F.col("_size"))
    fused = fuse_mean(out, [f"_pct_{m}" for m in members], name)
    return fused.drop("_size", *[f"_{p}_{m}" for p in ("rank", "pct") for m in members])


def causal_fusion(rows: DataFrame, members: list[str], fit_split: str = "val", name: str = "score") -> DataFrame:
    """Mean of member ECDFs fitted on one split only, applied row by row."""
    out = rows
    fit = F.col("split") == fit_split
    for m in members:
        counts = rows.groupBy(m).agg(F.count_if(fit).alias("_c"))
        total = rows.filter(fit).agg(F.count(F.lit(1))).scalar()
        ecdf = cumulative(counts, [], m, ["_c"], prefix="_cum").select(
            m, (F.col("_cum_c") / total).alias(f"_ecdf_{m}"))
        out = out.join(ecdf, m)
    return fuse_mean(out, [f"_ecdf_{m}" for m in members], name).drop(*[f"_ecdf_{m}" for m in members])
