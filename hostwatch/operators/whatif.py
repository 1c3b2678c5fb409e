"""Counterfactual packet transforms: only packets sent by an attacker change.

``attackers`` is a table of source addresses (``src_ip``), joined once; its size does not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PAYLOAD_EDGES, SEED, STAGES, UNCLASSIFIED, Settings
from ..functions.columns import floor_div
from ..functions.crypto import portable_hash
from ..functions.net import is_internal
from ..functions.rules import infer_stage
from .metrics import hash_order
from .ordered import row_numbers
from .packets import TCP, all_window_features

SOCKET = ["src_ip", "dst_ip", "src_port"]
_SHIFT = 1 << 20          # packet_no room for the chunks of one payload
_VARIANT = 1 << 32        # source key room for the variant number


OWN = "_own"              # true on packets that an attacker sent


def marked(packets: DataFrame, attackers: DataFrame) -> DataFrame:
    known = attackers.select("src_ip").distinct().withColumn(OWN, F.lit(True))
    return packets.join(known, "src_ip", "left").select(*packets.columns, F.coalesce(OWN, F.lit(False)).alias(OWN))


def permute_ports(packets: DataFrame, attackers: DataFrame, seed=SEED) -> DataFrame:
    """Permute destination ports inside each of an attacker's sockets."""
    return _permute_ports(marked(packets, attackers), seed).drop(OWN)


def _permute_ports(packets: DataFrame, seed=SEED) -> DataFrame:
    own = packets.filter(OWN)
    span = 3_600_000_000
    placed = row_numbers(own, SOCKET, floor_div("ts_us", span), [F.col("ts_us"), F.col("packet_no")], "_pos")
    ports = hash_order(own.select(*SOCKET, "packet_no", F.col("dst_port").alias("_port")), SOCKET, seed,
                       ["packet_no"], "_pos").drop("packet_no")
    moved = placed.join(ports, [*SOCKET, "_pos"]).withColumn("dst_port", F.col("_port")).drop("_pos", "_port")
    return packets.filter(~F.col(OWN)).unionByName(moved.select(*packets.columns))


def pace(packets: DataFrame, attackers: DataFrame, factor: float) -> DataFrame:
    """Stretch an attacker's timing about its first packet."""
    return _pace(marked(packets, attackers), factor).drop(OWN)


def _pace(packets: DataFrame, factor: float) -> DataFrame:
    first = packets.filter(OWN).groupBy("src_ip").agg(F.min("ts_us").alias("_t0"))
    out = packets.join(first, "src_ip", "left")
    moved = F.col("_t0") + F.round((F.col("ts_us") - F.col("_t0")) * F.lit(float(factor))).cast("long")
    return out.withColumn("ts_us", F.coalesce(moved, F.col("ts_us"))).select(*packets.columns)


def rechunk_payload(packets: DataFrame, attackers: DataFrame, target_bin: int = 3) -> DataFrame:
    """Cut payloads of attackers that exceed a size bin into as few chunks as fit it, equal but for one byte.

    No byte is added or lost, time and flags repeat; sizes that cannot be cut so raise.
    """
    return _rechunk_payload(marked(packets, attackers), target_bin).drop(OWN)


def _rechunk_payload(packets: DataFrame, target_bin: int = 3) -> DataFrame:
    if not 0 <= target_bin < len(PAYLOAD_EDGES) - 1:
        raise ValueError(f"target bin {target_bin} is outside the payload edges")
    lo, hi = PAYLOAD_EDGES[target_bin], PAYLOAD_EDGES[target_bin + 1]
    size = F.col("payload_len").cast("long")
    chunks = F.when(F.col(OWN) & (size >= hi), floor_div(size - 1, hi - 1) + 1).otherwise(F.lit(1))
    df = packets.withColumn("_n", chunks).withColumn(
        "_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    part = F.floor(size / F.col("_n")) + (F.col("_k") < size % F.col("_n")).cast("long")
    part = F.when((F.col("_n") > 1) & (part < lo), F.raise_error(
        F.lit(f"equal chunks cannot land in bin {target_bin}")).cast("long")).otherwise(part)
    return df.withColumn("payload_len", part).withColumn(
        "packet_no", F.col("packet_no") * F.lit(_SHIFT) + F.col("_k")).drop("_n", "_k")


def randomise_header(packets: DataFrame, attackers: DataFrame, field: str, low: int, high: int, seed=SEED) -> DataFrame:
    """Uniform TTL or TCP window in [low, high) on packets that attackers sent."""
    return _randomise_header(marked(packets, attackers), field, low, high, seed).drop(OWN)


def _randomise_header(packets: DataFrame, field: str, low: int, high: int, seed=SEED) -> DataFrame:
    if field not in ("ttl", "tcp_win"):
        raise ValueError("field must be 'ttl' or 'tcp_win'")
    mask = F.col(OWN)
    if field == "tcp_win":
        mask = mask & (F.col("protocol") == TCP)
    drawn = F.lit(low) + portable_hash(f"{seed}:{field}", "packet_no") % F.lit(high - low)
    return packets.withColumn(field, F.when(mask, drawn.cast("int")).otherwise(F.col(field)))


# Variant names, their steps in order, default ranges.
_STEPS = {
    "port_random": _permute_ports,
    "pad_payload": lambda d: _rechunk_payload(d, 3),
    "ttl_random": lambda d: _randomise_header(d, "ttl", 32, 65),
    "win_random": lambda d: _randomise_header(d, "tcp_win", 8192, 65536),
    "pace_5x": lambda d: _pace(d, 5.0),
    "pace_15x": lambda d: _pace(d, 15.0),
}
#: Public registry: each transform takes (packets, attackers); other packets come back as they were.
TRANSFORMS = {
    "port_random": permute_ports,
    "pad_payload": lambda packets, attackers: rechunk_payload(packets, attackers, 3),
    "ttl_random": lambda packets, attackers: randomise_header(packets, attackers, "ttl", 32, 65),
    "win_random": lambda packets, attackers: randomise_header(packets, attackers, "tcp_win", 8192, 65536),
    "pace_5x": lambda packets, attackers: pace(packets, attackers, 5.0),
    "pace_15x": lambda packets, attackers: pace(packets, attackers, 15.0),
}
VARIANTS = {
    "baseline": (),
    "port_random": ("port_random",),
    "pace_5x": ("pace_5x",),
    "pace_15x": ("pace_15x",),
    "pad_payload": ("pad_payload",),
    "ttl_random": ("ttl_random",),
    "win_random": ("win_random",),
    "combined": ("port_random", "pad_payload", "ttl_random", "win_random", "pace_15x"),
}


def apply_variant(packets: DataFrame, attackers: DataFrame, variant: str) -> DataFrame:
    return _apply_variant(marked(packets, attackers), variant).drop(OWN)


def _apply_variant(packets: DataFrame, variant: str) -> DataFrame:
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; have {sorted(VARIANTS)}")
    return reduce(lambda d, step: _STEPS[step](d), VARIANTS[variant], packets)


def evasion_table(packets: DataFrame, attackers: DataFrame, settings: Settings, variants=tuple(VARIANTS),
                  cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Cost on the wire and effect on the features, one row per variant.

    Variants are unioned and measured in one grouped job: the variant number rides in
    the high bits of the source key. Only attacker rows feed the attacker's windows.
    ``cut`` may write the transformed rows once; four aggregations read them.
    """
    variants = list(variants)
    own = packets.join(attackers.select("src_ip").distinct(), "src_ip", "left_semi").withColumn(OWN, F.lit(True))
    rows = reduce(DataFrame.unionByName, [
        _apply_variant(own, v).drop(OWN).withColumn("variant_no", F.lit(i).cast("long"))
        for i, v in enumerate(variants)])
    rows = cut(rows)
    cost = rows.groupBy("variant_no").agg(
        ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("span_s"), F.count(F.lit(1)).alias("pkts"),
        F.sum(F.col("payload_len").cast("long")).alias("bytes"),
        F.count_distinct("dst_ip", "dst_port").alias("reach"),
        F.count_distinct("dst_ip", "src_port", "dst_port").alias("sockets"))
    keyed = rows.withColumn("src_ip", F.col("variant_no") * F.lit(_VARIANT) + F.col("src_ip"))
    wf = all_window_features(keyed, settings.grid)
    wf = (wf.withColumn("variant_no", floor_div("src_ip", _VARIANT))
          .withColumn("src_ip", F.pmod("src_ip", F.lit(_VARIANT)))
          .withColumn("internal", is_internal("src_ip").cast("int"))
          .withColumn("stage", infer_stage(settings.stage_rules)))
    effect = wf.groupBy("variant_no").agg(
        F.count(F.lit(1)).alias("windows"), F.max("ttl_var").alias("ttl_var"), F.max("tcp_win_var").alias("win_var"),
        F.max("sequential_port_ratio").alias("seq_ratio"), F.max("sent_pkts").alias("peak_pkts"),
        F.max("sent_bytes").alias("peak_bytes"),
        *[F.sum(f"payload_hist_{i}").alias(f"hist_{i}") for i in range(len(PAYLOAD_EDGES))],
        *[F.count_if(F.col("stage") == s).alias(f"stage_{s}") for s in (*STAGES, UNCLASSIFIED)])
    names = packets.sparkSession.createDataFrame(list(enumerate(variants)), "variant_no long, variant string")
    out = names.join(cost, "variant_no", "left").join(effect, "variant_no", "left").drop("variant_no")
    sent = F.when(F.col("pkts").isNotNull(), F.col("pkts")).otherwise(
        F.raise_error(F.lit("none of the attacker addresses sent a packet")).cast("long"))
    return out.withColumn("pkts", sent)
