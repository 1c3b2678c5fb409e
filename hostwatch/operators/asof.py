"""Host state as of a window end, from flows stamped at their END.

A flow's totals are only known once it completed, so nothing in flight leaks back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Grid
from ..functions.columns import floor_div
from ..functions.net import ip_to_text
from .ordered import latest_before
from .packets import bins_to_windows

STATE = ("bytes", "pkts", "duration_s", "syn", "rst")


def flow_events(flows: DataFrame) -> DataFrame:
    """Both endpoints of every flow as (host, end_us, state, tie) events."""
    base = flows.select(
        "src_ip", "dst_ip", (F.col("start_us") + F.coalesce("duration", F.lit(0.0)).cast("long")).alias("end_us"),
        (F.col("fwd_bytes") + F.col("bwd_bytes")).alias("bytes"),
        (F.col("fwd_pkts") + F.col("bwd_pkts")).cast("double").alias("pkts"),
        (F.col("duration") / 1e6).alias("duration_s"), F.col("syn").cast("double").alias("syn"),
        F.col("rst").cast("double").alias("rst"),
        F.struct("start_us", "src_ip", "dst_ip", "src_port", "dst_port").alias("tie"))
    sides = [base.select(ip_to_text(ip).alias("host"), "end_us", F.struct(*STATE).alias("state"), "tie")
             for ip in ("src_ip", "dst_ip")]
    return reduce(DataFrame.unionByName, sides)


def host_state_asof(readouts: DataFrame, flows: DataFrame, grid: Grid, chunk_us: int | None = None) -> DataFrame:
    """State of the last flow that ended strictly before each window's end; zeros if none."""
    ro = readouts.select("host", "window_id", ((F.col("window_id") * grid.stride_us) + grid.window_us).alias("read_us"))
    out = latest_before(flow_events(flows), ro, "host", "end_us", "read_us", "state",
                        chunk_us or 200 * grid.stride_us, "tie")
    return out.select("host", "window_id", *[F.coalesce(F.col(f"state.{c}"), F.lit(0.0)).alias(c) for c in STATE])


def neighbour_agg(readouts: DataFrame, flows: DataFrame, grid: Grid) -> DataFrame:
    """Mean state over the flows of a host that ended inside each window; zeros if none.

    Ends are summed into stride bins first, then composed into windows.
    """
    ev = flow_events(flows).select("host", floor_div("end_us", grid.stride_us).alias("bin_id"), "state.*")
    bins = ev.groupBy("host", "bin_id").agg(F.count(F.lit(1)).alias("n_flows"), *[F.sum(c).alias(c) for c in STATE])
    per = bins_to_windows(bins, grid).groupBy("host", "window_id").agg(
        F.sum("n_flows").alias("n_flows"), *[(F.sum(c) / F.sum("n_flows")).alias(f"mean_{c}") for c in STATE])
    return (readouts.select("host", "window_id").distinct().join(per, ["host", "window_id"], "left")
            .fillna(0))
