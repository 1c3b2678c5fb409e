from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hostwatch.config import STAGES, Grid
from hostwatch.operators import labels as lb

GRID = Grid()
TL = "date string, name string, stage string, start string, end string, attacker_ips array<string>, victim_ips array<string>"


def timeline(spark, *attacks):
    return spark.createDataFrame(list(attacks), TL)


def windows(spark, *rows):
    return spark.createDataFrame([(h, w, w * 5, "2018-02-14") for h, w in rows], "host string, window_id long, window_start long, day string")


ATTACK = ("2018-02-14", "FTP-BruteForce", "initial_access", "10:32", "10:33", ["9.9.9.9"], ["172.31.0.5"])
START = 1518618720   # 2018-02-14 14:32 UTC


def stages(spark, df, *attacks):
    iv = lb.attack_intervals(timeline(spark, *attacks), 4)
    return {(r.host, r.window_id): r.stage for r in lb.label_windows(df, iv, GRID).collect()}


def test_offset_and_half_open_boundaries(spark):
    iv = lb.attack_intervals(timeline(spark, ATTACK), 4).first()
    assert (iv.start_s, iv.end_s, sorted(iv.hosts)) == (START, START + 60, ["172.31.0.5", "9.9.9.9"])
    w = START // 5
    df = windows(spark, *[("9.9.9.9", w + d) for d in (-3, -2, 0, 11, 12)], ("1.1.1.1", w))
    got = stages(spark, df, ATTACK)
    assert [got["9.9.9.9", w + d] for d in (-3, -2, 0, 11, 12)] == [
        "benign", "initial_access", "initial_access", "initial_access", "benign"]
    assert got["1.1.1.1", w] == "benign"


def test_higher_stage_wins(spark):
    low = (*ATTACK[:2], "recon", *ATTACK[3:])
    high = (*ATTACK[:2], "impact", *ATTACK[3:])
    assert set(stages(spark, windows(spark, ("9.9.9.9", START // 5)), high, low).values()) == {"impact"}


def test_pseudonymised_hosts_fail(spark):
    with pytest.raises(Exception, match="real addresses"):
        stages(spark, windows(spark, ("deadbeef00112233", 5)), ATTACK)


def test_rank_round_trip(spark):
    df = spark.createDataFrame([(s,) for s in STAGES], "s string")
    got = df.select("s", lb.rank_stage(lb.stage_rank(F.col("s"))).alias("t"), lb.stage_rank(F.col("s")).alias("r")).collect()
    assert [r.r for r in got] == list(range(7)) and all(r.s == r.t for r in got)


def labelled(spark):
    rows = [("a", 1, "benign"), ("a", 2, "benign"), ("a", 4, "impact"), ("a", 4, "impact"), ("b", 2, "c2")]
    return spark.createDataFrame([(h, w, s, "2018-02-14") for h, w, s in rows], "host string, window_id long, stage string, day string")


def test_shift_uses_window_ids_not_rows(spark):
    got = sorted((r.host, r.window_id, r.stage) for r in lb.shift_target(labelled(spark), 2).collect())
    assert got == [("a", 2, "impact")]
    assert lb.shift_target(labelled(spark), 0).count() == 5


def test_drop_family(spark):
    kept = lb.drop_family(labelled(spark), timeline(spark, ATTACK), "bruteforce")
    assert {r.stage for r in kept.collect()} == {"benign"}
    with pytest.raises(ValueError):
        lb.drop_family(labelled(spark), timeline(spark, ATTACK), "bot")


def test_class_counts_flags(spark):
    df = labelled(spark).withColumn("split", F.lit("train"))
    got = {r.stage: (r.train, r.val, r.total, r.absent, r.small) for r in lb.class_counts(df, ("train", "val")).collect()}
    assert got["impact"] == (2, 0, 2, 0, 1) and got["recon"] == (0, 0, 0, 1, 0) and len(got) == 7


def test_episode_groups_follow_the_label(spark):
    ep = spark.createDataFrame([("a", 0, 100, 110), ("a", 1, 105, 120)], "host string, episode_no long, start_s long, end_s long")
    rows = windows(spark, ("a", 19), ("a", 20), ("a", 21), ("a", 24), ("a", 25), ("b", 20))
    at = lambda k: {(r.host, r.window_id): r.group_id for r in lb.episode_groups(rows, ep, GRID, k).collect()}
    now = at(0)
    assert now["a", 19] == "host:a" and now["a", 20] == "episode:0:a"
    assert now["a", 21] == "episode:1:a" and now["a", 24] == "episode:1:a"     # the later episode wins
    assert now["a", 25] == "host:a" and now["b", 20] == "host:b"
    assert at(1)["a", 19] == "episode:0:a"
    with pytest.raises(ValueError):
        lb.episode_groups(rows, ep, GRID, -1)


def test_windows_of_intervals_pass_no_driver(spark, tmp_path):
    """A small file of intervals may open out to millions of windows: they are shuffled, whatever the file's size."""
    from pyspark.sql import functions as F

    from hostwatch.operators import metrics as me
    rows = [("10.0.0.9", w, "test", "a", 0, "benign", 0.5, w * GRID.stride_seconds) for w in range(40)]
    spark.createDataFrame(rows, "host string, window_id long, split string, model string, y int, stage string, score double, "
                                "window_start long").write.parquet(str(tmp_path / "w"))
    spark.createDataFrame([("10.0.0.9", "test", "x", "scan", 5, 25, 5)], "host string, split string, name string, stage string, "
                          "start_s long, end_s long, episode_no long").write.parquet(str(tmp_path / "e"))
    wins, eps = (spark.read.parquet(str(tmp_path / x)) for x in "we")
    limits = wins.select("model").distinct().withColumn("threshold", F.lit(0.5))
    many = {"label_windows": lb.label_windows(wins.drop("stage"), eps.withColumn("hosts", F.array("host")), GRID),
            "shift_target": lb.shift_target(wins, 2), "label_agreement": lb.label_agreement(wins, (1,)),
            "episode_groups": lb.episode_groups(wins, eps, GRID), "first_alerts": me.first_alerts(wins, eps, GRID, ["model"]),
            "per_episode_report": me.per_episode_report(wins, eps, limits, GRID)}
    for name, df in many.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan, name
        assert plan.count("BroadcastHashJoin") == (name == "per_episode_report"), name
    assert many["first_alerts"].first().first_alert == 5 and many["per_episode_report"].first().n_windows == 5
