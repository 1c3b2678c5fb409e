"""Tab-separated operator stage logs, and host sampling for a capture day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SEED, STAGES
from ..functions.crypto import portable_hash
from ..functions.times import local_to_epoch


def read_operator_log(spark: SparkSession, path: str, date: str | None = None,
                      capture: tuple[int, int] | None = None, stages=STAGES) -> DataFrame:
    """Stage rows to UTC intervals with their parties; anything malformed fails.

    Lines are comments (#), two-field headers or five-field stage rows. Without
    ``date`` it comes from a ``date=`` partition folder. Benign rows are dropped.
    An interval outside the capture (start_s, end_s) fails.
    """
    lines = spark.read.text(path)
    if date is not None:
        lines = lines.withColumn("date", F.lit(date))
    lines = lines.filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    parts = F.split("value", "\t")
    fail = lambda text: F.raise_error(F.concat(F.lit(f"{text}: "), F.col("value")))
    shaped = F.when(F.size(parts).isin(2, 5), parts).otherwise(
        fail("operator-log line needs 2 or 5 fields").cast("array<string>"))
    rows = lines.withColumn("p", shaped).filter(F.size("p") == 5)
    field = lambda i: F.trim(F.col("p")[i])
    rows = rows.select("value", F.col("date").cast("string").alias("date"), field(0).alias("stage"),
                       field(1).alias("_from"), field(2).alias("_to"), field(3).alias("attacker"),
                       field(4).alias("victim")).filter(F.col("stage") != STAGES[0])
    stage = F.when(F.col("stage").isin(list(stages)), F.col("stage")).otherwise(fail("unknown stage"))
    rows = rows.select("value", "date", stage.alias("stage"), local_to_epoch("date", "_from", 0).alias("start_s"),
                       local_to_epoch("date", "_to", 0).alias("end_s"),
                       F.filter(F.array("attacker", "victim"), lambda h: h != "").alias("hosts"))
    bad = F.when(F.coalesce(F.col("end_s") <= F.col("start_s"), F.lit(True)), fail("stage ends at or before it starts"))
    bad = bad.when(F.size("hosts") == 0, fail("stage names no host"))
    if capture is not None:
        bad = bad.when((F.col("end_s") <= capture[0]) | (F.col("start_s") >= capture[1]),
                       fail("stage lies outside the capture"))
    checked = bad.otherwise(F.col("date"))
    return rows.withColumn("date", checked).drop("value")


def sample_hosts(hosts: DataFrame, timeline_hosts: DataFrame, n: int, seed=SEED) -> DataFrame:
    """Per day every timeline host that is present, plus n others in a seeded order."""
    key = ["day", "host"]
    hosts = hosts.select(*key).distinct()
    keep = hosts.join(timeline_hosts.select(*key).distinct(), key, "left_semi").withColumn("reason", F.lit("timeline"))
    rest = hosts.join(timeline_hosts.select(*key).distinct(), key, "left_anti")
    w = Window.partitionBy("day").orderBy("_h", "host")
    drawn = (rest.withColumn("_h", portable_hash(seed, *key)).withColumn("_n", F.row_number().over(w))
             .filter(F.col("_n") <= n).select(*key, F.lit("sampled").alias("reason")))
    return keep.unionByName(drawn)


def missing_victims(hosts: DataFrame, victims: DataFrame) -> DataFrame:
    """Victims of a day without any captured host row: lost attack evidence."""
    key = ["day", "host"]
    return victims.select(*key).distinct().join(hosts.select(*key).distinct(), key, "left_anti")


def require_victims(hosts: DataFrame, victims: DataFrame) -> None:
    lost = missing_victims(hosts, victims).limit(20).collect()
    if lost:
        raise ValueError(f"victim host(s) without capture: {[tuple(r) for r in lost]}")
