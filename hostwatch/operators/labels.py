"""Attack timelines, interval labelling and target shifts.

Intervals are turned into the grid windows they touch, so every interval join here
is an equi join on (host, window_id): it spreads a hot host over its windows and
needs no size bound on the timeline. Windows of intervals grow with the timeline, so
they are shuffled and never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STAGES, Grid
from ..functions.columns import floor_div
from ..functions.rules import attack_family
from ..functions.times import local_to_epoch
from .ordered import by_shuffle

BENIGN = STAGES[0]


def stage_rank(stage: Column, stages=STAGES) -> Column:
    return (F.array_position(F.array(*[F.lit(s) for s in stages]), stage) - 1).cast("int")


def rank_stage(rank: Column, stages=STAGES) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in stages]), rank + 1)


def assign_split(df: DataFrame, split_map: DataFrame, day: str = "day") -> DataFrame:
    """Add the ``split`` of every row's day; a day that the map does not name raises, no row is lost."""
    out = df.join(split_map.select(F.col("day").alias(day), "split"), day, "left")
    unknown = F.raise_error(F.concat(F.lit("no split for day "), F.coalesce(F.col(day), F.lit("NULL")))).cast("string")
    return out.withColumn("split", F.coalesce("split", unknown))


def attack_intervals(timeline: DataFrame, offset_hours: int) -> DataFrame:
    """Timeline rows to UTC intervals with the set of parties (attackers and victims)."""
    return timeline.select(
        "date", "name", "stage",
        local_to_epoch("date", "start", offset_hours).alias("start_s"),
        local_to_epoch("date", "end", offset_hours).alias("end_s"),
        F.array_union("attacker_ips", "victim_ips").alias("hosts"))


def attacker_episodes(timeline: DataFrame, offset_hours: int, split_map: DataFrame | None = None) -> DataFrame:
    """One episode per (attack, attacker host), tagged with the split of its day."""
    ep = timeline.select(
        F.explode("attacker_ips").alias("host"), "date", "name", "stage",
        local_to_epoch("date", "start", offset_hours).alias("start_s"),
        local_to_epoch("date", "end", offset_hours).alias("end_s"))
    if split_map is None:
        return ep
    return assign_split(ep, split_map, "date")


def overlap_windows(intervals: DataFrame, grid: Grid) -> DataFrame:
    """Half-open overlap: every window with ws < end and ws + window > start."""
    lo = floor_div(F.col("start_s") - grid.window_seconds, grid.stride_seconds) + 1
    hi = floor_div(F.col("end_s") + grid.stride_seconds - 1, grid.stride_seconds) - 1
    return intervals.filter(lo <= hi).withColumn("window_id", F.explode(F.sequence(lo, hi)))


def closed_windows(episodes: DataFrame, grid: Grid, offset_seconds: int = 0,
                   grace_seconds: int = 0) -> DataFrame:
    """Every window whose start, moved by the offset, lies in [start - grace, end]."""
    lo = floor_div(F.col("start_s") - grace_seconds - offset_seconds + grid.stride_seconds - 1,
                   grid.stride_seconds)
    hi = floor_div(F.col("end_s") - offset_seconds, grid.stride_seconds)
    return episodes.filter(lo <= hi).withColumn("window_id", F.explode(F.sequence(lo, hi)))


def label_windows(wf: DataFrame, intervals: DataFrame, grid: Grid, stages=STAGES) -> DataFrame:
    """Add ``stage``: the highest-priority attack that overlaps a party's window, else benign.

    Fails on pseudonymised hosts, which could never match a timeline address.
    """
    parties = intervals.select(F.explode("hosts").alias("host"), "start_s", "end_s",
                               stage_rank(F.col("stage"), stages).alias("_rank"))
    touched = (overlap_windows(parties, grid).groupBy("host", "window_id")
               .agg(F.max("_rank").alias("_rank")))
    host = F.col("host")
    dotted = F.when(host.contains("."), host).otherwise(
        F.raise_error(F.concat(F.lit("labels need real addresses, got host "), host)).cast("string"))
    return (wf.withColumn("host", dotted).join(by_shuffle(touched), ["host", "window_id"], "left")
            .withColumn("stage", rank_stage(F.coalesce("_rank", F.lit(0)), stages)).drop("_rank"))


def shift_target(labelled: DataFrame, k: int) -> DataFrame:
    """Replace ``stage`` by the same host's stage k windows later; no such window, no row.

    Windows have gaps, so this joins on window_id; of several rows for one window the gravest stage counts.
    """
    if k == 0:
        return labelled
    future = (labelled.select("host", (F.col("window_id") - k).alias("window_id"), stage_rank(F.col("stage")).alias("_r"))
              .groupBy("host", "window_id").agg(rank_stage(F.max("_r")).alias("stage")))
    return labelled.drop("stage").join(by_shuffle(future), ["host", "window_id"])


def label_agreement(labelled: DataFrame, ks) -> DataFrame:
    """Share of rows whose attack label k windows ahead equals the label now."""
    now = labelled.select("host", "window_id", (F.col("stage") != BENIGN).alias("y0"))
    out = None
    for k in ks:
        future = labelled.groupBy("host", (F.col("window_id") - k).alias("window_id")).agg(
            (F.max("stage") != BENIGN).alias("yk"))
        part = now.join(by_shuffle(future), ["host", "window_id"]).agg(
            F.lit(int(k)).alias("k"), F.count(F.lit(1)).alias("n_rows"),
            F.avg((F.col("y0") == F.col("yk")).cast("double")).alias("agreement"))
        out = part if out is None else out.unionByName(part)
    return out


def drop_family(labelled: DataFrame, timeline: DataFrame, family: str, check: bool = True) -> DataFrame:
    """Remove a family's attack rows on its days (benign rows stay); raise if none match."""
    days = timeline.filter(attack_family("name") == family).select(F.col("date").alias("day")).distinct()
    attacks = labelled.join(days, "day", "left_semi").filter(F.col("stage") != BENIGN)
    if check and attacks.isEmpty():
        raise ValueError(f"holding out {family!r} removes nothing: not a family of these rows")
    keyed = days.withColumn("_attack", F.lit(True))
    return (labelled.withColumn("_attack", F.col("stage") != BENIGN)
            .join(keyed, ["day", "_attack"], "left_anti").drop("_attack"))


def class_counts(labelled: DataFrame, splits, stages=STAGES, small: int = 500) -> DataFrame:
    """Stage x split counts in stage order, with total and absent / small flags."""
    per = labelled.groupBy("stage", "split").agg(F.count(F.lit(1)).alias("n"))
    wide = per.groupBy("stage").agg(*[
        F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(s) for s in splits])
    names = labelled.sparkSession.createDataFrame(
        [(i, s) for i, s in enumerate(stages)], "stage_no int, stage string")
    out = names.join(wide, "stage", "left").fillna(0)
    total = sum((F.col(s) for s in splits[1:]), F.col(splits[0]))
    return out.select("stage_no", "stage", *splits, total.alias("total"),
                      (total == 0).cast("int").alias("absent"),
                      ((total > 0) & (total < small)).cast("int").alias("small"))


def episode_groups(rows: DataFrame, episodes: DataFrame, grid: Grid, k: int = 0) -> DataFrame:
    """Add ``group_id``: the (episode, host) a row's label belongs to, else its host.

    A row at window w carries the label of w + k, hence the k*stride offset.
    ``episodes`` needs ``episode_no``; the later episode wins.
    """
    if k < 0:
        raise ValueError("horizon must be >= 0")
    member = (closed_windows(episodes, grid, offset_seconds=k * grid.stride_seconds)
              .groupBy("host", "window_id").agg(F.max("episode_no").alias("_ep")))
    label = F.when(F.col("_ep").isNotNull(), F.concat_ws(":", F.lit("episode"), F.col("_ep").cast("string"), "host"))
    return (rows.join(by_shuffle(member), ["host", "window_id"], "left")
            .withColumn("group_id", label.otherwise(F.concat(F.lit("host:"), F.col("host")))).drop("_ep"))
