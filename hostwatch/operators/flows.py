"""Flow assembly (sessionisation) and flow-to-window spreading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FLAGS, FLOW_TIMEOUT_SECONDS, MISSING_INIT_WIN, NET24_BUCKETS, SERVER_PORTS, Grid
from ..functions.columns import floor_div, ratio
from ..functions.crypto import net24_bucket
from ..functions.net import ip_to_text, is_internal, is_server_port
from .ordered import previous_row, running_total

FLOW_FIELDS = (
    "start_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "duration",
    "fwd_bytes", "bwd_bytes", "fwd_pkts", "bwd_pkts", *FLAGS,
    "iat_mean", "iat_std", "iat_max", "init_win_fwd", "init_win_bwd", "label",
)
PAIR = ["pair_lo", "pair_hi", "protocol"]


def with_pair(packets: DataFrame) -> DataFrame:
    """Unordered endpoint pair, and whether the packet was sent by the lower endpoint."""
    a = F.col("src_ip") * 65536 + F.col("src_port")
    b = F.col("dst_ip") * 65536 + F.col("dst_port")
    return packets.select("*", F.least(a, b).alias("pair_lo"), F.greatest(a, b).alias("pair_hi"),
                          (a <= b).alias("from_lo"))


def sessions(packets: DataFrame, timeout_seconds: int = FLOW_TIMEOUT_SECONDS,
             chunk_us: int | None = None) -> DataFrame:
    """Add flow_no per endpoint pair; a quiet gap longer than the timeout starts a flow."""
    timeout_us = timeout_seconds * 1_000_000
    chunk_us = chunk_us or max(timeout_us // 12, 1_000_000)
    chunk, order = floor_div("ts_us", chunk_us), ["ts_us", "packet_no"]
    px = previous_row(with_pair(packets), PAIR, chunk, order, ["ts_us"])
    gap = F.col("ts_us") - F.col("prev_ts_us")
    starts = gap.isNull() | (gap > timeout_us)
    px = px.withColumn("iat_us", F.when(~starts, gap)).drop("prev_ts_us")
    return running_total(px, PAIR, chunk, [F.col(c) for c in order],
                         {"flow_no": F.col("iat_us").isNull().cast("long")})


SUMS = ("lo_bytes", "hi_bytes", "lo_pkts", "hi_pkts", *FLAGS)


def piece_width(timeout_seconds: int, chunk_us: int | None = None) -> int:
    """Microseconds of a chunk: no more than the timeout and 2,000 s."""
    timeout_us = timeout_seconds * 1_000_000
    return max(1, min(chunk_us or max(timeout_us // 12, 1_000_000), timeout_us, 2_000_000_000))


def piece_sums() -> list[Column]:
    """Aggregates of the packets of a piece that need no order."""
    at, lo, size = F.struct("ts_us", "packet_no"), F.col("from_lo"), F.col("payload_len").cast("long")
    syn_lo, syn_hi = lo & (F.col("syn") == 1), ~lo & (F.col("syn") == 1)
    return [
        F.min_by(F.struct("from_lo", "src_ip", "src_port", "dst_ip", "dst_port"), at).alias("first"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"),
        F.sum(F.when(lo, size).otherwise(0)).alias("lo_bytes"), F.sum(F.when(~lo, size).otherwise(0)).alias("hi_bytes"),
        F.count_if(lo).alias("lo_pkts"), F.count_if(~lo).alias("hi_pkts"), *[F.sum(F.col(f).cast("long")).alias(f) for f in FLAGS],
        F.min(F.when(syn_lo, F.struct(at.alias("at"), "tcp_win"))).alias("lo_syn"),
        F.min(F.when(syn_hi, F.struct(at.alias("at"), "tcp_win"))).alias("hi_syn")]


def flow_pieces(packets: DataFrame, timeout_seconds: int = FLOW_TIMEOUT_SECONDS, chunk_us: int | None = None) -> DataFrame:
    """One summary per (endpoint pair, chunk of time): what a flow needs to know of those packets.

    A chunk is no wider than the timeout, so its packets belong to one flow; neighbours can be merged when only first
    and last time are known. Packets are shuffled once and never read again. Chunks of at most 2,000 s keep the sum of squared
    gaps in a LONG: gaps in a chunk add up to its width at most.
    """
    px = with_pair(packets).withColumn("chunk", floor_div("ts_us", piece_width(timeout_seconds, chunk_us)))
    order = Window.partitionBy(*PAIR, "chunk").orderBy("ts_us", "packet_no")
    px = px.withColumn("_gap", F.col("ts_us") - F.lag("ts_us").over(order))
    return px.groupBy(*PAIR, "chunk").agg(
        *piece_sums(), F.sum(F.col("_gap") * F.col("_gap")).alias("gap_sq"), F.max("_gap").alias("gap_max"))


def assemble_flows(packets: DataFrame, timeout_seconds: int = FLOW_TIMEOUT_SECONDS,
                   chunk_us: int | None = None) -> DataFrame:
    """Bidirectional flows in the canonical 23 columns; first packet sets direction.

    Pieces are numbered along their pair and merged: all aggregates are partial-able and kept per
    endpoint (lo / hi); which side is forward is only decided on the finished flow row.
    """
    timeout_us = timeout_seconds * 1_000_000
    pieces = flow_pieces(packets, timeout_seconds, chunk_us)
    # a task sees one piece per chunk of a pair, whatever the pair's packets
    along = Window.partitionBy(*PAIR).orderBy("chunk")
    gap = F.col("start_us") - F.lag("end_us").over(along)
    pieces = pieces.withColumn("_join", F.when(gap <= timeout_us, gap))
    pieces = pieces.withColumn("flow_no", F.sum(F.col("_join").isNull().cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return finish_flows(pieces.groupBy(*PAIR, "flow_no").agg(
        F.min_by("first", "chunk").alias("first"), F.min("start_us").alias("start_us"), F.max("end_us").alias("_end_us"),
        *[F.sum(c).alias(c) for c in SUMS],
        F.greatest(F.max("gap_max"), F.max("_join")).cast("double").alias("iat_max"),
        (F.coalesce(F.sum(wide("gap_sq")), F.lit(0)) + F.coalesce(F.sum(wide("_join") * wide("_join")), F.lit(0))).alias("_sq"),
        F.min("lo_syn")["tcp_win"].alias("lo_win"), F.min("hi_syn")["tcp_win"].alias("hi_win")))


def finish_flows(flows: DataFrame) -> DataFrame:
    """The canonical columns of merged flows: forward is the side that sent the first packet."""
    # gaps add up to the duration: their variance is exact up to the last division
    gaps, span = (F.col("lo_pkts") + F.col("hi_pkts") - 1), F.col("_end_us") - F.col("start_us")
    exact = gaps.cast("decimal(12,0)") * F.col("_sq").cast("decimal(26,0)") - span.cast("decimal(19,0)") * span.cast("decimal(19,0)")
    flows = flows.withColumn("iat_mean", ratio(span, gaps)).withColumn(
        "iat_std", F.when(gaps > 0, F.sqrt(F.greatest(exact.cast("double"), F.lit(0.0))) / gaps))

    def side(fwd: bool, name: str) -> Column:
        same, other = (f"lo_{name}", f"hi_{name}") if fwd else (f"hi_{name}", f"lo_{name}")
        return F.when(F.col("first.from_lo"), F.col(same)).otherwise(F.col(other))

    missing = F.lit(MISSING_INIT_WIN)
    return flows.select(
        "start_us", "first.src_ip", "first.dst_ip", "first.src_port", "first.dst_port", "protocol",
        (F.col("_end_us") - F.col("start_us")).cast("double").alias("duration"),
        side(True, "bytes").cast("double").alias("fwd_bytes"),
        side(False, "bytes").cast("double").alias("bwd_bytes"),
        side(True, "pkts").alias("fwd_pkts"), side(False, "pkts").alias("bwd_pkts"),
        *FLAGS,
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("iat_mean", "iat_std", "iat_max")],
        F.coalesce(side(True, "win"), missing).alias("init_win_fwd"),
        F.coalesce(side(False, "win"), missing).alias("init_win_bwd"),
        F.lit("unlabeled").alias("label"),
    )


_STRETCH = 4096          # windows in one stretch
_BLOCK = 64              # windows of a source that are summed in one task
_FLOWS = 100_000         # flows that a task spreads, about
_PIECE = ("src_ip", "_block", "_first", "_last")
_SHORT = 32              # a flow that covers fewer windows whole gives each of them its own row
_SPREAD = ("fwd_bytes", "fwd_pkts", *FLAGS)
_COUNTED = ("n", "win_n", "win_sum", "server")


def _window_span(flows: DataFrame, grid: Grid) -> DataFrame:
    """Add _timed, _end, and the first and last window that each flow meets (_lo.._hi); flows that meet none go."""
    start, dur = F.col("start_us"), F.col("duration")
    timed = dur.isNotNull() & ~F.isnan(dur) & (F.abs(dur) < float("inf")) & (dur > 0)
    first = floor_div(start, grid.stride_us) - (grid.n_bins - 1)
    out = flows.withColumn("_timed", timed).withColumn("_end", F.when(timed, start + dur.cast("long")))
    out = out.withColumn("_lo", first).withColumn("_hi", F.when(
        F.col("_timed"), floor_div(F.col("_end") - 1, grid.stride_us)).otherwise(first + (grid.n_bins - 1)))
    return out.filter(~F.col("_timed") | (F.col("_end") > start))


def _peer_spans(spans: DataFrame) -> DataFrame:
    """(src_ip, b, hi): windows b..hi in which a source meets a destination; those of one destination do not overlap.

    Spans are reduced to the longest per (source, destination, first window) before they are put in order, so a task
    holds a row per window of a pair at most; each then counts for the windows beyond all earlier ones.
    """
    pair = ["src_ip", "dst_ip"]
    rows = spans.groupBy(*pair, F.col("_lo").alias("lo")).agg(F.max("_hi").alias("hi"))
    earlier = Window.partitionBy(*pair).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest("lo", F.max("hi").over(earlier) + 1)
    return rows.select("src_ip", begin.alias("b"), "hi").filter("b <= hi")


def flows_to_windows(flows: DataFrame, grid: Grid, server_ports=SERVER_PORTS,
                     average_sentinel: bool = False) -> DataFrame:
    """Sent-side features of flow input, spread over windows by time overlap.

    Zero, missing or non-finite durations count in full in each covering window.
    ``average_sentinel`` keeps -1 ("no SYN seen") in the SYN window mean.

    A flow is sent as a row per block of 64 windows to the task that sums those windows of its source, and spread there: no row of a
    single window is shuffled. Difference arrays: if a flow covers 32 windows or more whole, only the windows that it covers in part are
    sent so (at most n_bins at either end, and one more); for the others its rate is added at the first of
    them and taken away behind the last. Whether a window is covered follows from whole numbers, so rounding adds no row. Only sources
    with such long flows (or long spans of a destination) need running sums; they are added to the rows of single windows.
    The flows are counted once, for the number of tasks (each holds the rows of some hundred thousand flows' windows) and for the most
    windows that one meets: without long ones there are no steps to look for.
    """
    start, dur, size, stride = F.col("start_us"), F.col("duration"), grid.window_us, grid.stride_us
    win = F.col("init_win_fwd").cast("long")
    spans = _window_span(flows.select(
        "src_ip", "dst_ip", "start_us", "duration", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in _SPREAD],
        (win if average_sentinel else F.when(win >= 0, win)).alias("_win"),
        is_server_port("src_port", server_ports).cast("long").alias("server")), grid)
    spans = spans.withColumn("_a", floor_div(start + (stride - 1), stride)).withColumn("_b", floor_div(F.col("_end") - size, stride))
    whole = F.coalesce(F.col("_timed") & (F.col("_b") - F.col("_a") >= _SHORT), F.lit(False))
    span = lambda a, b: F.struct(a.alias("_first"), b.alias("_last"))
    counts = {"n": F.lit(1).cast("long"), "win_n": F.col("_win").isNotNull().cast("long"),
              "win_sum": F.coalesce("_win", F.lit(0)).cast("long"), "server": F.col("server")}
    zero = F.lit(0).cast("long")

    lo, hi = F.col("_lo"), F.col("_hi")
    own = spans.select("*", F.inline(F.when(whole, F.array(span(lo, F.col("_a") - 1), span(F.col("_b") + 1, hi))).otherwise(
        F.array(span(lo, hi)))))
    rows = _by_block(own).select(
        *_PIECE, *_SPREAD, F.when(F.col("_timed"), start).alias("_start"), F.when(F.col("_timed"), dur).alias("_dur"),
        *[v.alias(c) for c, v in counts.items()], zero.alias("peers"))

    def up_and_down(df: DataFrame, first: Column, behind: Column, values: dict[str, Column]) -> DataFrame:
        """Two rows: the values at window ``first``, and their opposites at window ``behind``."""
        both = df.select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("_sign"))
        return both.select("src_ip", F.when(F.col("_sign") == 1, first).otherwise(behind).alias("window_id"),
                           *[(v * F.col("_sign")).alias(c) for c, v in values.items()])

    rate = {c: F.col(c) * (F.lit(float(size)) / dur) for c in _SPREAD}
    # a flow that covers _SHORT windows whole, or begins such a span of a destination, meets more windows than that
    total, widest = spans.agg(F.count(F.lit(1)), F.max(hi - lo)).first()
    peers, short = _peer_spans(spans), F.col("hi") - F.col("b") < _SHORT
    nothing = {**{c: F.lit(0.0) for c in _SPREAD}, **{c: zero for c in _COUNTED}}
    one = F.lit(1).cast("long")
    met = _by_block(peers.filter(short).withColumnsRenamed({"b": "_first", "hi": "_last"})).select(
        *_PIECE, *[v.alias(c) for c, v in nothing.items()], one.alias("peers"))
    if (widest or 0) >= _SHORT:
        steps = up_and_down(spans.filter(whole), F.col("_a"), F.col("_b") + 1, {**rate, **counts, "peers": zero}).unionByName(
            up_and_down(peers.filter(~short), F.col("b"), F.col("hi") + 1, {**nothing, "peers": one}))
        met = met.unionByName(_by_block(_running_windows(steps, [*_SPREAD, *_COUNTED, "peers"])).select(
            *_PIECE, *_SPREAD, *_COUNTED, "peers"))
    out = rows.unionByName(met, allowMissingColumns=True)
    # flows are dealt before they are spread: a row per flow and block is shuffled, and all rows of a window meet in the task that makes them
    parts = max(flows.sparkSession.sparkContext.defaultParallelism, -(-total // _FLOWS))
    out = out.repartition(parts, "src_ip", "_block").select("*", F.explode(F.sequence("_first", "_last")).alias("window_id"))
    w0 = F.col("window_id") * F.lit(stride)
    frac = F.when(F.col("_start").isNotNull(), (F.least(F.col("_start") + F.col("_dur").cast("long"), w0 + size)
                                                - F.greatest("_start", w0)) / F.col("_dur")).otherwise(F.lit(1.0))
    out = out.groupBy("src_ip", "_block", "window_id").agg(
        *[F.sum(F.col(c) * frac).alias(c) for c in _SPREAD], *[F.sum(c).alias(c) for c in (*_COUNTED, "peers")]).filter("n > 0")
    return out.select(
        "src_ip", "window_id", F.col("fwd_bytes").alias("sent_bytes"), F.col("fwd_pkts").alias("sent_pkts"), *FLAGS,
        F.greatest(ratio(F.col("win_sum"), F.col("win_n")), F.lit(0.0)).alias("syn_win_mean"),
        ratio(F.col("server"), F.col("n")).alias("server_port_ratio"), F.col("peers").alias("distinct_dst_ips"))


def _running_windows(steps: DataFrame, columns: list[str]) -> DataFrame:
    """What holds in windows _first.._last, from steps that hold until the next one; windows in which nothing holds have no row.

    Steps are summed per (source, window) before a source's are put in order: a task holds a row per window at most.
    """
    along = Window.partitionBy("src_ip").orderBy("window_id")
    every = steps.groupBy("src_ip", "window_id").agg(*[F.sum(c).alias(c) for c in columns])
    held = every.select("src_ip", "window_id", (F.lead("window_id").over(along) - 1).alias("_to"),
                        *[F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in columns])
    held = held.filter("(n > 0 OR peers > 0) AND _to >= window_id").select(   # no list is longer than a stretch
        "*", F.explode(F.sequence(floor_div("window_id", _STRETCH), floor_div("_to", _STRETCH))).alias("_s"))
    low, high = F.greatest("window_id", F.col("_s") * _STRETCH), F.least("_to", F.col("_s") * _STRETCH + (_STRETCH - 1))
    return held.select("src_ip", low.alias("_first"), high.alias("_last"), *columns)


def _by_block(spans: DataFrame) -> DataFrame:
    """Rows of windows _first.._last cut at every ``_BLOCK`` windows; empty spans go."""
    cut = spans.filter("_first <= _last").select(
        "*", F.explode(F.sequence(floor_div("_first", _BLOCK), floor_div("_last", _BLOCK))).alias("_block"))
    return cut.withColumn("_first", F.greatest("_first", F.col("_block") * _BLOCK)).withColumn(
        "_last", F.least("_last", F.col("_block") * _BLOCK + (_BLOCK - 1)))


def role_features(flows: DataFrame, key: bytes, server_ports=SERVER_PORTS,
                  buckets: int = NET24_BUCKETS) -> DataFrame:
    """Per host: internal flag, /24 bucket, share of its own ports that are server ports."""
    sides = [flows.select(F.col(f"{s}_ip").alias("ip"), F.col(f"{s}_port").alias("port"))
             for s in ("src", "dst")]
    own = reduce(DataFrame.unionByName, sides)
    out = own.groupBy("ip").agg(
        ratio(F.count_if(is_server_port("port", server_ports)), F.count(F.lit(1))).alias("server_port_ratio"))
    return out.select(ip_to_text("ip").alias("host"), is_internal("ip").cast("int").alias("internal"),
                      net24_bucket(ip_to_text("ip"), key, buckets).alias("net24_bucket"),
                      "server_port_ratio")
