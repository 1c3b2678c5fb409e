"""Per-host time sequences: gaps, fixed-length segments, recent history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SEED, SEQUENCE_WINDOWS
from ..functions.columns import floor_div
from ..functions.crypto import portable_hash, pseudonym
from .metrics import HASH_BITS
from .ordered import previous_row, row_numbers

_CHUNK_WINDOWS = 4096


def gap_features(rows: DataFrame, clamp: int | None = None) -> DataFrame:
    """Add ``gap``: strides since the host's previous row; first or repeated rows get 1."""
    df = previous_row(rows, ["host"], floor_div("window_id", _CHUNK_WINDOWS), ["window_id"], ["window_id"])
    step = F.col("window_id") - F.col("prev_window_id")
    gap = F.when(step > 0, step).otherwise(F.lit(1))
    return df.withColumn("gap", F.least(gap, F.lit(clamp)) if clamp else gap).withColumn(
        "has_previous", F.col("prev_window_id").isNotNull()).drop("prev_window_id")


def gap_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Gap quantiles and tail shares per key, from pre-aggregated gap counts."""
    counts = gap_features(rows).filter("has_previous").groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("n"))
    share = lambda t: (F.sum(F.when(F.col("gap") > t, F.col("n")).otherwise(0)) / F.sum("n"))
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("n_gaps"),
        *[F.percentile("gap", F.lit(q), F.col("n")).alias(name)
          for name, q in (("p50", .5), ("p90", .9), ("p95", .95), ("p99", .99))],
        F.max("gap").alias("max_gap"), *[share(t).alias(f"frac_gt_{t}") for t in (10, 100, 1000)])


def segment(rows: DataFrame, features: list[str], length: int = SEQUENCE_WINDOWS,
            keys: tuple = ("host",)) -> DataFrame:
    """Consecutive fixed-length segments per host, right-padded, with mask and row index.

    A segment never exceeds ``length`` rows, so its collected list is bounded.
    """
    keys = list(keys)
    numbered = row_numbers(rows, keys, floor_div("window_id", _CHUNK_WINDOWS), [F.col("window_id")])
    pos = F.col("row_no") - 1
    item = F.struct(F.pmod(pos, F.lit(length)).alias("pos"), "window_id", "y",
                    F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    segs = numbered.groupBy(*keys, floor_div(pos, length).alias("segment_no")).agg(
        F.array_sort(F.collect_list(item)).alias("rows"))
    n = F.size("rows")
    pad = F.lit(length) - n
    zeros = F.array_repeat(F.lit(0.0), len(features))
    fill = lambda arr, filler: F.concat(arr, F.array_repeat(filler, pad))
    return segs.select(
        *keys, "segment_no", n.alias("n_real"),
        fill(F.col("rows.x"), zeros).alias("x"), fill(F.col("rows.y"), F.lit(0)).alias("y"),
        fill(F.transform("rows", lambda _: F.lit(False)), F.lit(True)).alias("pad_mask"),
        fill(F.col("rows.window_id"), F.lit(None).cast("long")).alias("window_ids"))


def scatter_back(segments: DataFrame, values: str, name: str = "score", keys: tuple = ("host",)) -> DataFrame:
    """Per-position values of each segment back to one row per real window."""
    zipped = F.explode(F.arrays_zip(F.col("window_ids"), F.col(values).alias("v"), F.col("pad_mask")))
    return (segments.select(*keys, zipped.alias("z")).filter(~F.col("z.pad_mask"))
            .select(*keys, F.col("z.window_ids").alias("window_id"), F.col("z.v").alias(name)))


def padding_stats(segments: DataFrame, length: int = SEQUENCE_WINDOWS) -> DataFrame:
    n = F.col("n_real")
    lengths = segments.groupBy("n_real").agg(F.count(F.lit(1)).alias("c"))  # at most `length` rows
    return lengths.agg(
        F.sum("c").alias("n_segments"),
        (1 - F.sum(n * F.col("c")) / (F.sum("c") * length)).alias("pad_share"),
        (F.sum(F.when(n == length, F.col("c")).otherwise(0)) / F.sum("c")).alias("full_share"),
        (F.sum(F.when(n * 2 < length, F.col("c")).otherwise(0)) / F.sum("c")).alias("mostly_pad_share"),
        (F.sum(n * F.col("c")) / F.sum("c")).alias("mean_length"),
        F.percentile("n_real", F.lit(0.5), F.col("c")).alias("median_length"),
        F.percentile("n_real", F.lit(0.1), F.col("c")).alias("p10_length"))


def newest_windows(rows: DataFrame, n: int, tie: list[Column] | None = None) -> DataFrame:
    """The newest n windows of each host; the rank filter prunes before the shuffle."""
    if n < 1:
        raise ValueError("n must be >= 1")
    w = Window.partitionBy("host").orderBy(F.col("window_id").desc(), *(tie or []))
    return rows.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= n)


def host_sequences(rows: DataFrame, features: list[str], max_len: int = SEQUENCE_WINDOWS) -> DataFrame:
    """Most recent windows per host in time order, real rows first, then padding."""
    recent = newest_windows(rows, max_len)
    item = F.struct("window_id", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    per = recent.groupBy("host").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    pad = F.lit(max_len) - F.size("rows")
    zeros = F.array_repeat(F.lit(0.0), len(features))
    return per.select(
        "host", F.col("rows.window_id").alias("window_ids"),
        F.concat(F.col("rows.x"), F.array_repeat(zeros, pad)).alias("x"),
        F.concat(F.transform("rows", lambda _: F.lit(False)), F.array_repeat(F.lit(True), pad)).alias("pad_mask"))


def epoch_node_ids(hosts: DataFrame, key: bytes, epoch: int, seed=SEED, heldout: bool = False,
                   split: str = "train") -> DataFrame:
    """Dense ids 0..n-1 over the distinct hosts, in a keyed order that changes per epoch."""
    named = hosts.select("host").distinct().withColumn("pseudonym", pseudonym("host", key, heldout, split))
    named = named.withColumn("_h", portable_hash(f"{seed}:{epoch}", "pseudonym"))
    out = row_numbers(named, [], floor_div("_h", 1 << (HASH_BITS - 7)), [F.col("_h"), F.col("pseudonym")])
    return out.select("host", (F.col("row_no") - 1).alias("node_id"))
