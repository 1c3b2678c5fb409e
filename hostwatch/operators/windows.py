"""Window feature rows: assembly, masks, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, META_FIELDS, PACKET_FIELDS, SENT_FIELDS, Settings
from ..functions.crypto import net24_bucket, pseudonym
from ..functions.net import ip_to_text, is_internal
from .labels import assign_split
from .packets import all_window_features


def network_of(ip: str) -> Column:
    """The /24 network of an address as a number (-1: no address)."""
    return F.coalesce(F.shiftright(ip, 8).bitwiseAND(F.lit(0xFFFFFF)), F.lit(-1).cast("long"))


def network_buckets(addresses: DataFrame, key: bytes, ip: str = "src_ip") -> DataFrame:
    """network, net24_bucket: the keyed hash taken once for each /24 network that occurs."""
    return addresses.groupBy(network_of(ip).alias("network")).agg(F.min(ip).alias("ip")).select(
        "network", net24_bucket(ip_to_text("ip"), key).alias("net24_bucket"))


def add_roles(df: DataFrame, key: bytes | None, ip: str = "src_ip", networks: DataFrame | None = None) -> DataFrame:
    """internal / net24_bucket of the source; without a key both stay 0.

    ``networks``: ``network_buckets`` of all sources, best written before; then no hash is taken in the rows.
    """
    if key is None:
        return df.withColumn("internal", F.lit(0)).withColumn("net24_bucket", F.lit(0).cast("long"))
    df = df.withColumn("internal", is_internal(ip).cast("int"))
    if networks is None:
        return df.withColumn("net24_bucket", net24_bucket(ip_to_text(ip), key))
    return df.withColumn("network", network_of(ip)).join(networks, "network", "left").drop("network")


def window_day(window_start: Column) -> Column:
    return F.date_format(F.timestamp_seconds(window_start), "yyyy-MM-dd")


def finish_features(merged: DataFrame, settings: Settings, key: bytes | None,
                    pseudonyms: bool = False, split: str = "train", heldout: bool = False,
                    networks: DataFrame | None = None) -> DataFrame:
    """Meta + feature columns in the configured order; missing values become 0. ``networks``: see ``add_roles``."""
    numeric = [*PACKET_FIELDS, *SENT_FIELDS]
    for c in numeric:
        if c not in merged.columns:
            merged = merged.withColumn(c, F.lit(0.0))
    df = add_roles(merged.fillna(0, subset=numeric), key, networks=networks)
    text = ip_to_text("src_ip")
    if pseudonyms:
        if key is None:
            raise RuntimeError("pseudonyms need a key")
        text = pseudonym(text, key, heldout=heldout, split=split)
    start = F.col("window_id") * F.lit(settings.grid.stride_seconds)
    df = df.select("*", text.alias("host"), start.alias("window_start"))
    df = df.withColumn("day", window_day(F.col("window_start")))
    return df.select(*META_FIELDS, *settings.feature_columns())


def build_window_features(packets: DataFrame, settings: Settings = DEFAULTS, key: bytes | None = None,
                          **kwargs) -> DataFrame:
    """Packets to the full (host, window) feature matrix."""
    return finish_features(all_window_features(packets, settings.grid), settings, key, **kwargs)


def mask_flow_only(df: DataFrame) -> DataFrame:
    """Zero the packet statistics, which flow input cannot carry (apply after scaling)."""
    return df.select(*[F.lit(0.0).alias(c) if c in PACKET_FIELDS else F.col(c) for c in df.columns])


def union_splits(df: DataFrame, split_map: DataFrame, split: str | None = None) -> DataFrame:
    """Rows of the days of a split (or of all splits, tagged)."""
    tagged = assign_split(df, split_map)
    return tagged if split is None else tagged.filter(F.col("split") == split)


def split_overlap(df: DataFrame) -> DataFrame:
    """(host, window_id) pairs and days found in more than one split; must be empty."""
    pairs = (df.groupBy("host", "window_id").agg(F.count_distinct("split").alias("n_splits"))
             .filter("n_splits > 1")
             .select(F.concat_ws("@", "host", "window_id").alias("item"), "n_splits"))
    days = (df.groupBy("day").agg(F.count_distinct("split").alias("n_splits"))
            .filter("n_splits > 1").select(F.col("day").alias("item"), "n_splits"))
    return pairs.unionByName(days)
