"""Packet aggregations on the window grid.

Input: packets(packet_no, ts_us, src_ip, dst_ip, src_port, dst_port, protocol,
ttl, tcp_win, is_frag, payload_len, is_retrans, syn..urg). Every statistic is
aggregated once into stride bins (partial) and each window is composed from its
bins (final), so raw packets are never multiplied by the window overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FLAGS, PACKET_FIELDS, PAYLOAD_EDGES, SENT_FIELDS, SERVER_PORTS, Grid
from ..functions.columns import floor_div, ratio
from ..functions.net import is_server_port

TCP = 6
_BLOCK_BINS = 512


def assign_windows(df: DataFrame, grid: Grid, ts: str = "ts_us") -> DataFrame:
    """One row per covering window (n_bins consecutive ids per timestamp)."""
    last = floor_div(ts, grid.stride_us)
    return df.withColumn("window_id", F.explode(F.sequence(last - (grid.n_bins - 1), last)))


def bins_to_windows(bins: DataFrame, grid: Grid) -> DataFrame:
    """Bin b feeds windows b-n_bins+1 .. b."""
    return bins.withColumn(
        "window_id", F.explode(F.sequence(F.col("bin_id") - (grid.n_bins - 1), F.col("bin_id")))
    ).drop("bin_id")


def mark_retransmissions(packets: DataFrame) -> DataFrame:
    """Set is_retrans on repeats of (flow 4-tuple, seq, payload_len).

    Only unfragmented TCP packets that carry data, SYN or FIN count. Needs ``seq``.
    Keys seen once never leave the aggregation, so the join side holds repeats only.
    """
    key = ["src_ip", "dst_ip", "src_port", "dst_port", "seq", "payload_len"]
    eligible = ((F.col("protocol") == TCP) & (F.col("is_frag") == 0)
                & ((F.col("payload_len") > 0) | (F.col("syn") == 1) | (F.col("fin") == 1)))
    first = (packets.filter(eligible)
             .groupBy(*key)
             .agg(F.min(F.struct("ts_us", "packet_no")).alias("_first"), F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1").drop("_n"))
    repeat = F.coalesce(eligible & (F.struct("ts_us", "packet_no") > F.col("_first")), F.lit(False))
    return (packets.drop("is_retrans").join(first, key, "left")
            .withColumn("is_retrans", repeat.cast("int")).drop("_first"))


def _hist(i: int) -> Column:
    size = F.col("payload_len")
    inside = size >= PAYLOAD_EDGES[i]
    if i + 1 < len(PAYLOAD_EDGES):
        inside = inside & (size < PAYLOAD_EDGES[i + 1])
    return F.count_if(inside)


def _var_pop(n: str, total: str, squares: str) -> Column:
    """Population variance from integer sums, exact until the last division; 0 when empty."""
    wide = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,0)")
    exact = wide(n) * wide(squares) - wide(total) * wide(total)
    return ratio(exact, F.col(n).cast("double") * F.col(n).cast("double"))


def _packet_sums() -> dict[str, Column]:
    ttl, win = F.col("ttl").cast("long"), F.when(F.col("protocol") == TCP, F.col("tcp_win").cast("long"))
    return {
        "n": F.count(F.lit(1)), "ttl_sum": F.sum(ttl), "ttl_sq": F.sum(ttl * ttl),
        "win_n": F.count(win), "win_sum": F.sum(win), "win_sq": F.sum(win * win),
        "frag_flag_count": F.sum(F.col("is_frag").cast("long")),
        "retransmission_count": F.sum(F.col("is_retrans").cast("long")),
        **{f"payload_hist_{i}": _hist(i) for i in range(len(PAYLOAD_EDGES))},
    }


def _sent_sums(server_ports) -> dict[str, Column]:
    return {
        "sent_pkts": F.count(F.lit(1)), "sent_bytes": F.sum(F.col("payload_len").cast("long")),
        **{f: F.sum(F.col(f).cast("long")) for f in FLAGS},
        "_syn_win": F.sum(F.when(F.col("syn") == 1, F.col("tcp_win").cast("long")).otherwise(0)),
        "_server": F.count_if(is_server_port("src_port", server_ports)),
    }


def _window_sums(packets: DataFrame, grid: Grid, sums: dict[str, Column], sub_us: int | None) -> DataFrame:
    """Sums and sequential-port hits per (src_ip, window_id) from one shuffle of the packets.

    Packets are ordered inside (source, sub-bin). Sub-bin summaries are then ordered
    inside blocks of bins with a halo of n_bins-1 bins, so neighbours that share a
    window meet although no task ever sees a whole source. A port step across bins
    counts in the windows that hold both packets: ids up to the earlier bin.
    """
    sub_us = sub_us or grid.stride_us // 5
    if grid.stride_us % sub_us:
        raise ValueError("sub_us must divide the stride")
    reach = grid.n_bins - 1
    w = Window.partitionBy("src_ip", "_sub").orderBy("ts_us", "packet_no")
    px = packets.withColumn("_sub", floor_div("ts_us", sub_us))
    px = px.select("*", F.lag("dst_port").over(w).alias("_prev"), F.lead("dst_port").over(w).alias("_next"))
    subs = px.groupBy("src_ip", "_sub").agg(
        *[c.alias(n) for n, c in sums.items()],
        F.count_if(F.col("dst_port") - F.col("_prev") == 1).alias("_hits"),
        F.max(F.when(F.col("_prev").isNull(), F.col("dst_port"))).alias("_first"),
        F.max(F.when(F.col("_next").isNull(), F.col("dst_port"))).alias("_last"))
    subs = subs.withColumn("bin_id", floor_div("_sub", grid.stride_us // sub_us))
    own = floor_div("bin_id", _BLOCK_BINS)
    halo = floor_div(F.col("bin_id") + reach, _BLOCK_BINS)
    rows = subs.withColumn("_own", own).withColumn(
        "_block", F.explode(F.array_distinct(F.array(F.col("_own"), halo))))
    along = Window.partitionBy("src_ip", "_block").orderBy("_sub")
    rows = rows.select("*", F.lag("bin_id").over(along).alias("_pbin"),
                       (F.col("_first") - F.lag("_last").over(along) == 1).alias("_step"))
    rows = rows.filter(F.col("_own") == F.col("_block"))
    inside = F.coalesce(F.col("_step") & (F.col("_pbin") == F.col("bin_id")), F.lit(False))
    crossing = F.coalesce(F.col("_step") & (F.col("_pbin") < F.col("bin_id")), F.lit(False))
    bins = rows.groupBy("src_ip", "_block", "bin_id").agg(
        *[F.sum(n).alias(n) for n in sums], F.sum(F.col("_hits") + inside.cast("long")).alias("_hits"),
        F.max(F.when(crossing, F.col("_pbin"))).alias("_from"))
    wins = bins.withColumn("window_id", F.explode(F.sequence(F.col("bin_id") - reach, F.col("bin_id"))))
    return wins.groupBy("src_ip", "window_id").agg(
        *[F.sum(n).alias(n) for n in sums],
        F.sum(F.col("_hits") + F.coalesce((F.col("window_id") <= F.col("_from")).cast("long"), F.lit(0))).alias("_hits"))


def _packet_columns() -> list[Column]:
    n = F.col("n")
    return [
        (F.col("ttl_sum") / n).alias("ttl_mean"), _var_pop("n", "ttl_sum", "ttl_sq").alias("ttl_var"),
        ratio(F.col("win_sum"), F.col("win_n")).alias("tcp_win_mean"),
        _var_pop("win_n", "win_sum", "win_sq").alias("tcp_win_var"),
        F.col("frag_flag_count"), F.col("retransmission_count"),
        F.when(n >= 2, F.col("_hits") / (n - 1)).otherwise(F.lit(0.0)).alias("sequential_port_ratio"),
        *[F.col(f"payload_hist_{i}") for i in range(len(PAYLOAD_EDGES))],
    ]


def _sent_columns() -> list[Column]:
    return [F.col("sent_bytes"), F.col("sent_pkts"), *[F.col(f) for f in FLAGS],
            ratio(F.col("_syn_win"), F.col("syn")).alias("syn_win_mean"),
            (F.col("_server") / F.col("sent_pkts")).alias("server_port_ratio")]


def port_window_features(packets: DataFrame, grid: Grid) -> DataFrame:
    """distinct_dst_ports and port_entropy per (src_ip, window_id)."""
    bins = (packets.groupBy("src_ip", floor_div("ts_us", grid.stride_us).alias("bin_id"), "dst_port")
            .agg(F.count(F.lit(1)).alias("c")))
    per_port = bins_to_windows(bins, grid).groupBy("src_ip", "window_id", "dst_port").agg(
        F.sum("c").alias("c"))
    out = per_port.groupBy("src_ip", "window_id").agg(
        F.count(F.lit(1)).alias("distinct_dst_ports"),
        F.sum("c").alias("_n"), F.sum(F.col("c") * F.log2("c")).alias("_clogc"))
    entropy = F.greatest(F.log2("_n") - F.col("_clogc") / F.col("_n"), F.lit(0.0))
    return out.select("src_ip", "window_id", "distinct_dst_ports", entropy.alias("port_entropy"))


def peer_window_features(packets: DataFrame, grid: Grid) -> DataFrame:
    """distinct_dst_ips per (src_ip, window_id)."""
    peers = packets.select("src_ip", floor_div("ts_us", grid.stride_us).alias("bin_id"), "dst_ip").distinct()
    return (bins_to_windows(peers, grid).distinct().groupBy("src_ip", "window_id")
            .agg(F.count(F.lit(1)).alias("distinct_dst_ips")))


def packet_window_features(packets: DataFrame, grid: Grid, sub_us: int | None = None) -> DataFrame:
    """The 17 packet statistics per (src_ip, window_id)."""
    wf = _window_sums(packets, grid, _packet_sums(), sub_us).select("src_ip", "window_id", *_packet_columns())
    return wf.join(port_window_features(packets, grid), ["src_ip", "window_id"]).select(
        "src_ip", "window_id", *PACKET_FIELDS)


def sent_window_features(packets: DataFrame, grid: Grid, server_ports=SERVER_PORTS) -> DataFrame:
    """The 11 sent-side aggregates per (src_ip, window_id): no order, so map-side sums only."""
    sums = _sent_sums(server_ports)
    bins = packets.groupBy("src_ip", floor_div("ts_us", grid.stride_us).alias("bin_id")).agg(
        *[c.alias(n) for n, c in sums.items()])
    wf = bins_to_windows(bins, grid).groupBy("src_ip", "window_id").agg(*[F.sum(c).alias(c) for c in sums])
    wf = wf.join(peer_window_features(packets, grid), ["src_ip", "window_id"])
    return wf.select("src_ip", "window_id", *_sent_columns(), "distinct_dst_ips").select(
        "src_ip", "window_id", *SENT_FIELDS)


def all_window_features(packets: DataFrame, grid: Grid, sub_us: int | None = None,
                        server_ports=SERVER_PORTS) -> DataFrame:
    """Both families of the same packets in one pass: what merging the two would give."""
    sums = {**_packet_sums(), **_sent_sums(server_ports)}
    wf = _window_sums(packets, grid, sums, sub_us).select(
        "src_ip", "window_id", *_packet_columns(), *_sent_columns())
    key = ["src_ip", "window_id"]
    return (wf.join(port_window_features(packets, grid), key).join(peer_window_features(packets, grid), key)
            .select(*key, *PACKET_FIELDS, *SENT_FIELDS))


def merge_features(packet_wf: DataFrame, sent_wf: DataFrame) -> DataFrame:
    """Full outer join of the two feature families; a missing side counts as 0."""
    return packet_wf.join(sent_wf, ["src_ip", "window_id"], "full_outer").fillna(0)
