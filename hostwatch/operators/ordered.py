"""Ordered computations that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(t)`` puts a whole key on one task. Here
every key is cut into chunks of its order axis. Rows are windowed inside their
chunk, one summary row per chunk is carried along the key, and the two are joined
on (key, chunk). The chunk summaries are the only thing a single task sees per
key: one row per chunk width of the order axis, or per about a million rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
QUANTILE_CUTS = 128
ROWS_PER_CHUNK = 1_000_000


def per_key(df: DataFrame) -> DataFrame:
    """Broadcast a table with one row per key of a grouping (models, splits, budgets): settings, not data.

    Joining it by shuffle would send all rows of a key to one task.
    """
    return F.broadcast(df)


def by_shuffle(df: DataFrame) -> DataFrame:
    """Join a table that grows with the data by shuffle, never through the driver.

    Spark sizes it by its compressed files and before rows are exploded: a timeline of 1 MB became a broadcast of 200 MB.
    Adaptive execution keeps such a broadcast, because taking it back adds a shuffle.
    """
    return df.hint("merge")


def previous_row(df: DataFrame, keys: list[str], chunk: Column, order: list[str],
                 values: list[str], prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<value>`` of the preceding row of the same key.

    ``chunk`` must not decrease along ``order``. Values must be non-null.
    """
    df = df.withColumn(CHUNK, chunk)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    df = df.select("*", *[F.lag(v).over(local).alias(f"_lag_{v}") for v in values],
                   F.lead(F.lit(True)).over(local).isNull().alias("_last"))
    ends = df.filter("_last").select(*keys, CHUNK, *[F.col(v).alias(f"_end_{v}") for v in values])
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    carry = ends.select(*keys, CHUNK,
                        *[F.lag(f"_end_{v}").over(along).alias(f"_carry_{v}") for v in values])
    joined = df.join(carry, [*keys, CHUNK], "left")
    scratch = [CHUNK, "_last", *[f"_lag_{v}" for v in values], *[f"_carry_{v}" for v in values]]
    return joined.select(
        "*", *[F.coalesce(f"_lag_{v}", f"_carry_{v}").alias(f"{prefix}{v}") for v in values]
    ).drop(*scratch)


def running_total(df: DataFrame, keys: list[str], chunk: Column, order: list,
                  values: dict[str, Column], chunk_descending: bool = False) -> DataFrame:
    """Add inclusive running sums ``name`` of each value along ``order`` per key.

    Rows that tie on ``order`` must be made unique by it (add a tie-break).
    """
    df = df.select("*", chunk.alias(CHUNK), *[v.alias(f"_v_{n}") for n, v in values.items()])
    local = (Window.partitionBy(*keys, CHUNK).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = df.groupBy(*keys, CHUNK).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    axis = F.col(CHUNK).desc() if chunk_descending else F.col(CHUNK).asc()
    # With no key left the chunk table itself is the only group: at most one row per chunk.
    along = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(axis)
             .rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select(*keys, CHUNK,
                           *[F.coalesce(F.sum(f"_t_{n}").over(along), F.lit(0)).alias(f"_b_{n}")
                             for n in values])
    out = df.select("*", *[F.sum(f"_v_{n}").over(local).alias(f"_r_{n}") for n in values])
    out = out.join(before, [*keys, CHUNK], "left")
    scratch = [CHUNK] + [f"_{k}_{n}" for k in "vrb" for n in values]
    return out.select("*", *[(F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in values]
                      ).drop(*scratch)


def row_numbers(df: DataFrame, keys: list[str], chunk: Column, order: list, name: str = "row_no",
                chunk_descending: bool = False) -> DataFrame:
    """1-based position of every row of a key along ``order``."""
    return running_total(df, keys, chunk, order, {name: F.lit(1).cast("long")}, chunk_descending)


def with_quantile_chunk(df: DataFrame, column: str, name: str, cuts: int = QUANTILE_CUTS) -> DataFrame:
    """Add a chunk number that does not decrease along a numeric column, about ``ROWS_PER_CHUNK`` rows each.

    ``cuts`` quantiles part the column; with more rows than they can hold, each part is divided again by value. Cuts
    and row count are one scalar subquery, and equal values share a chunk.
    """
    probs = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    points = df.select(F.struct(
        F.array_distinct(F.percentile_approx(column, probs, F.lit(10 * cuts))).alias("p"), F.min(column).alias("lo"),
        F.max(column).alias("hi"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(cuts * ROWS_PER_CHUNK))).alias("parts"))).scalar()
    df = df.withColumn("_cuts", points)
    value, parts = F.col(column), F.col("_cuts.parts")
    below = F.coalesce(F.size(F.filter("_cuts.p", lambda p: p <= value)), F.lit(0))
    low = F.coalesce(F.get("_cuts.p", below - 1), F.col("_cuts.lo"))
    high = F.coalesce(F.get("_cuts.p", below), F.col("_cuts.hi"))
    inner = F.when(high > low, F.least(parts - 1, F.floor((value - low) / (high - low) * parts))).otherwise(F.lit(0))
    return df.withColumn(name, (below * parts + F.greatest(F.lit(0), inner)).cast("long")).drop("_cuts")


def cumulative(df: DataFrame, keys: list[str], column: str, sums: list[str],
               descending: bool = False, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums over the distinct values of ``column`` per key.

    ``df`` must hold one row per (keys, column), i.e. be pre-aggregated.
    """
    order = [F.col(column).desc() if descending else F.col(column).asc()]
    df = with_quantile_chunk(df, column, "_qchunk")
    return running_total(df, keys, F.col("_qchunk"), order, {f"{prefix}{s}": F.col(s) for s in sums},
                         chunk_descending=descending).drop("_qchunk")


def latest_before(events: DataFrame, readouts: DataFrame, key: str, event_time: str,
                  read_time: str, value: str, chunk_us: int, tie: str) -> DataFrame:
    """As-of join: for every readout the value of the last event strictly before it.

    ``value`` may be a struct. Both sides share the chunk axis of time.
    """
    def chunk(c):
        return (F.col(c) / F.lit(chunk_us)).cast("long")

    last = (events.groupBy(key, chunk(event_time).alias(CHUNK))
            .agg(F.max_by(value, F.struct(event_time, tie)).alias("_end")))
    ev = events.select(F.col(key), F.col(event_time).alias("_t"), F.lit(1).alias("_kind"),
                       F.col(tie).alias("_tie"), F.col(value).alias("_val"),
                       *[F.lit(None).cast(f.dataType).alias(f"_r_{f.name}")
                         for f in readouts.schema.fields])
    ro = readouts.select(F.col(key), F.col(read_time).alias("_t"), F.lit(0).alias("_kind"),
                         F.lit(None).cast(events.schema[tie].dataType).alias("_tie"),
                         F.lit(None).cast(events.schema[value].dataType).alias("_val"),
                         *[F.col(f.name).alias(f"_r_{f.name}") for f in readouts.schema.fields])
    both = ev.unionByName(ro).withColumn(CHUNK, (F.col("_t") / F.lit(chunk_us)).cast("long"))
    # readouts sort before events of the same instant, so "strictly before" holds
    local = (Window.partitionBy(key, CHUNK).orderBy("_t", "_kind", "_tie")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = (both.withColumn("_in", F.last("_val", ignorenulls=True).over(local))
              .filter("_kind = 0"))
    # carry: last event of any earlier chunk, for chunks that hold readouts as well
    chunks = both.select(key, CHUNK).distinct().join(last, [key, CHUNK], "left")
    along = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(key, CHUNK, F.last("_end", ignorenulls=True).over(along).alias("_carry"))
    out = inside.join(carry, [key, CHUNK], "left")
    return out.select(*[F.col(f"_r_{f.name}").alias(f.name) for f in readouts.schema.fields],
                      F.coalesce("_in", "_carry").alias(value))


def exact_percentiles(df: DataFrame, keys: list[str], column: str,
                      points: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per key without buffering a key's values."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    cum = cumulative(counts, keys, column, ["_n"], prefix="_cum")
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    cum = cum.join(per_key(size), keys) if keys else cum.withColumn(
        "_size", size.select("_size").scalar())
    first, last = F.col("_cum_n") - F.col("_n"), F.col("_cum_n") - 1
    aggs = []
    for name, q in points.items():
        pos = (F.col("_size") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((lo >= first) & (lo <= last), F.col(column))).alias(f"_lo_{name}"),
            F.max(F.when((hi >= first) & (hi <= last), F.col(column))).alias(f"_hi_{name}"),
            F.max(pos - lo).alias(f"_w_{name}"),
        ]
    out = cum.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
        for n in points
    ])
