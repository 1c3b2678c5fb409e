"""Raw Ethernet frames to packet rows, as Column expressions over BINARY.

Input: frames(frame_no, ts_us, raw). Every frame becomes a packet row or a counted drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DROP_REASONS

# Header constants.
IPV4, IPV6, VLAN, TCP, UDP = 0x0800, 0x86DD, 0x8100, 6, 17


def _uint(offset: Column | int, n: int) -> Column:
    at = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    return F.conv(F.hex(F.substring(F.col("raw"), at, F.lit(n))), 16, 10).cast("long")


def classify_frames(frames: DataFrame) -> DataFrame:
    """Add the IP header offset and the drop reason (NULL for a parseable frame)."""
    size = F.length("raw")
    df = frames.withColumn("_size", size).withColumn("_outer", F.when(size >= 34, _uint(12, 2)))
    vlan = F.col("_outer") == VLAN
    df = df.withColumn("_type", F.when(vlan, _uint(16, 2)).otherwise(F.col("_outer")))
    df = df.withColumn("_ip", F.when(vlan, 18).otherwise(14))
    reason = (F.when(F.col("_size") < 34, DROP_REASONS[0]).when(F.col("_type") == IPV6, DROP_REASONS[1])
              .when(F.col("_type") != IPV4, DROP_REASONS[2])
              .when(F.col("_size") < F.col("_ip") + 20, DROP_REASONS[3]))
    return df.withColumn("drop_reason", reason).drop("_outer", "_type")


def decode_frames(frames: DataFrame) -> DataFrame:
    """IPv4 / TCP / UDP header fields; only a first fragment carries a transport header."""
    df = classify_frames(frames).filter("drop_reason is null")
    ip = F.col("_ip")
    df = df.select(
        "frame_no", "ts_us", "raw", "_size", ip,
        (_uint(ip, 1).bitwiseAND(F.lit(15)) * 4).cast("int").alias("_ihl"), _uint(ip + 2, 2).alias("_total"),
        _uint(ip + 6, 2).alias("_frag"), _uint(ip + 8, 1).cast("int").alias("ttl"),
        _uint(ip + 9, 1).cast("int").alias("protocol"),
        _uint(ip + 12, 4).alias("src_ip"), _uint(ip + 16, 4).alias("dst_ip"))
    offset = F.col("_frag").bitwiseAND(F.lit(0x1FFF))
    more = F.col("_frag").bitwiseAND(F.lit(0x2000))
    l4 = F.col("_ip") + F.col("_ihl")
    first = offset == 0
    is_tcp = first & (F.col("protocol") == TCP) & (F.col("_size") >= l4 + 20)
    is_udp = first & (F.col("protocol") == UDP) & (F.col("_size") >= l4 + 8)
    df = df.withColumn("_l4", l4).withColumn("_tcp", is_tcp).withColumn("_ports", is_tcp | is_udp).withColumn(
        "is_frag", ((more != 0) | (offset != 0)).cast("int"))
    at = F.col("_l4")
    header = F.when(F.col("_tcp"), F.shiftright(_uint(at + 12, 1), 4) * 4).when(F.col("_ports"), 8).otherwise(0)
    flags = F.when(F.col("_tcp"), _uint(at + 13, 1)).otherwise(F.lit(0))
    bit = lambda n, name: F.shiftright(flags, n).bitwiseAND(F.lit(1)).cast("int").alias(name)
    port = lambda o: F.when(F.col("_ports"), _uint(at + o, 2)).otherwise(0).cast("int")
    return df.select(
        F.col("frame_no").alias("packet_no"), "ts_us", "src_ip", "dst_ip", port(0).alias("src_port"),
        port(2).alias("dst_port"), "protocol", "ttl",
        F.when(F.col("_tcp"), _uint(at + 14, 2)).otherwise(0).cast("int").alias("tcp_win"), "is_frag",
        F.greatest(F.col("_total") - F.col("_ihl") - header, F.lit(0)).alias("payload_len"),
        F.lit(0).alias("is_retrans"), bit(1, "syn"), bit(4, "ack"), bit(0, "fin"), bit(2, "rst"), bit(3, "psh"),
        bit(5, "urg"), F.when(F.col("_tcp"), _uint(at + 4, 4)).otherwise(0).alias("seq"))


def frame_coverage(frames: DataFrame | None, spark=None) -> DataFrame:
    """Per drop reason: frames not parsed, and their share of all frames.

    No frame table means the history is unknown: NULL counts, never zero.
    """
    spark = spark or frames.sparkSession
    reasons = spark.createDataFrame([(r,) for r in DROP_REASONS], "drop_reason string")
    if frames is None:
        return reasons.select("drop_reason", F.lit(None).cast("long").alias("n"),
                              F.lit(None).cast("long").alias("n_frames"), F.lit(None).cast("double").alias("fraction"))
    counts = classify_frames(frames).groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    out = reasons.join(counts, "drop_reason", "left").fillna(0, subset=["n"]).withColumn("n_frames", total)
    return out.withColumn("fraction", F.when(F.col("n_frames") > 0, F.col("n") / F.col("n_frames")).otherwise(0.0))
