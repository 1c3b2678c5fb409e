"""Row-explosion form of the packet statistics: the plain meaning, for comparison only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostwatch.config import PACKET_FIELDS, PAYLOAD_EDGES, Grid
from hostwatch.operators.packets import assign_windows


def packet_window_features_exploded(packets: DataFrame, grid: Grid) -> DataFrame:
    key = ["src_ip", "window_id"]
    ex = assign_windows(packets, grid)
    step = F.col("dst_port") - F.lag("dst_port").over(Window.partitionBy(*key).orderBy("ts_us", "packet_no"))
    ex = ex.withColumn("hit", F.coalesce((step == 1).cast("int"), F.lit(0)))
    win = F.when(F.col("protocol") == 6, F.col("tcp_win"))
    edges = [*PAYLOAD_EDGES, 1 << 40]
    out = ex.groupBy(*key).agg(
        F.avg("ttl").alias("ttl_mean"), F.var_pop("ttl").alias("ttl_var"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("tcp_win_mean"),
        F.coalesce(F.var_pop(win), F.lit(0.0)).alias("tcp_win_var"),
        F.sum("is_frag").alias("frag_flag_count"), F.sum("is_retrans").alias("retransmission_count"),
        F.when(F.count("*") >= 2, F.sum("hit") / (F.count("*") - 1)).otherwise(0.0).alias("sequential_port_ratio"),
        *[F.count_if((F.col("payload_len") >= a) & (F.col("payload_len") < b)).alias(f"payload_hist_{i}")
          for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    ports = ex.groupBy(*key, "dst_port").count()
    total = F.sum("count").over(Window.partitionBy(*key))
    p = F.col("count") / F.col("_t")
    ports = ports.withColumn("_t", total).groupBy(*key).agg(
        F.count("*").alias("distinct_dst_ports"), (-F.sum(p * F.log2(p))).alias("port_entropy"))
    return out.join(ports, key).select(*key, *PACKET_FIELDS)
