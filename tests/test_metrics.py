from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostwatch.config import Grid
from hostwatch.operators import bootstrap as bs
from hostwatch.operators import fusion as fu
from hostwatch.operators import metrics as me

GRID = Grid()
SCORES = "model string, split string, host string, window_id long, window_start long, y int, score double"


def scores(spark, ys, ss, model="m", split="val", host="h"):
    return spark.createDataFrame([(model, split, host, i, i * 5, int(y), float(s)) for i, (y, s) in enumerate(zip(ys, ss))], SCORES)


def literal_threshold(y, s, budget):
    """Least score whose benign share at or above it is within the budget, else the next double above all scores."""
    benign = np.array(s)[np.array(y) == 0]
    return min((t for t in s if np.mean(benign >= t) <= budget), default=np.nextafter(max(s), np.inf))


def literal_auroc(y, s):
    pos, neg = [b for b, t in zip(s, y) if t], [b for b, t in zip(s, y) if not t]
    return sum((p > n) + .5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_threshold_and_auroc_match_plain_loops(spark):
    r = random.Random(4)
    y = [int(r.random() < .2) for _ in range(400)]
    s = [round(r.random() * .7 + .3 * t, 2) for t in y]
    df = scores(spark, y, s)
    got = {t.budget: t.threshold for t in me.threshold_at_fpr(df, ["model"], (0.0, .001, .01, .2)).collect()}
    assert got == {b: pytest.approx(literal_threshold(y, s, b), abs=1e-12) for b in got}
    assert me.auroc(df, ["model"]).first().auroc == pytest.approx(literal_auroc(y, s))


def test_nothing_alerts_when_the_top_is_benign(spark):
    df = scores(spark, [0, 0, 1], [.9, .1, .5])
    t = me.threshold_at_fpr(df, [], (0.1,)).first()
    assert t.threshold > .9 and t.n_benign == 2


def test_no_benign_rows_fail(spark):
    with pytest.raises(Exception, match="no benign rows"):
        me.threshold_at_fpr(scores(spark, [1, 1], [.1, .2]), ["model"], (0.1,)).collect()


def test_single_class_auroc_is_half(spark):
    assert me.auroc(scores(spark, [0, 0], [.1, .2]), ["model"]).first().auroc == 0.5


def test_operating_points_say_what_a_budget_bought(spark):
    df = scores(spark, [0] * 10 + [1], [i / 100 for i in range(10)] + [.9])
    got = {r.budget: r for r in me.operating_points(df, ["model"], (.01, .1)).collect()}
    assert got[.01].budget_expressible == 0 and got[.1].budget_expressible == 1
    assert got[.1].achieved_fpr == pytest.approx(.1) and got[.01].achieved_fpr == 0.0


def test_calibration_edges(spark):
    df = scores(spark, [0, 1, 1, 0], [0.1, 0.9, 0.95, 0.2])
    got = me.calibration_error(df, ["model"], 10).first().ece
    assert got == pytest.approx(np.mean([.1, abs(1 - .925), abs(1 - .925), .2]))
    bins = {r.score: r.b for r in scores(spark, [0] * 3, [0.0, .5, 1.0]).select("score", me.score_bin(2).alias("b")).collect()}
    assert bins == {0.0: 0, .5: 1, 1.0: 1}


def test_lead_time_keeps_undetected_episodes(spark):
    ep = spark.createDataFrame([("val", "a", 0, "x", 100, 200), ("val", "b", 1, "x", 100, 200), ("val", "c", 2, "x", 100, 200)],
                               "split string, host string, episode_no long, name string, start_s long, end_s long")
    al = spark.createDataFrame([("m", "val", h, w) for h, w in (("a", 28), ("a", 30), ("b", 38), ("c", 19), ("c", 41))],
                               "model string, split string, host string, window_id long")
    runs = spark.createDataFrame([("m", "val"), ("quiet", "val")], "model string, split string")
    leads = me.lead_times(al, ep, runs, GRID, ["model"])
    got = {(r.model, r.host): r.lead_seconds for r in leads.collect()}
    assert [got["m", h] for h in "abc"] == [60.0, 10.0, 0.0]
    assert [got["quiet", h] for h in "abc"] == [0.0] * 3
    s = {r.model: r for r in me.lead_summary(leads, ["model"]).collect()}["m"]
    assert (s.lead_median, s.episodes_detected, s.episodes_total) == (10.0, 2, 3)
    early = me.lead_times(al, ep, runs, GRID, ["model"], grace_seconds=5)
    assert {r.host: r.lead_seconds for r in early.filter("model = 'm'").collect()}["c"] == 105.0


def test_alert_rate_counts_host_days(spark):
    df = spark.createDataFrame([(10, 17280), (1, 0)], "a long, w long")
    got = [r[0] for r in df.select(me.alerts_per_host_day(F.col("a"), F.col("w"), GRID)).collect()]
    assert sorted(got) == [0.0, 10.0]


def test_dedup_and_random_baseline(spark):
    df = scores(spark, [0, 1, 1], [.2, .4, .6]).withColumn("window_id", F.lit(1).cast("long"))
    best, mean = (me.dedup_host_windows(df, ["model"], how).first() for how in ("max", "mean"))
    assert (best.score, mean.score, best.y, best.multiplicity) == (.6, pytest.approx(.4), 1, 3)
    with pytest.raises(ValueError):
        me.dedup_host_windows(df, [], "median")
    many = scores(spark, [0] * 200, np.linspace(0, 1, 200))
    n = many.groupBy("model").agg(F.lit(17).alias("n_alerts"))
    a, b = (sorted(r.window_id for r in me.random_baseline(many, n, ["model"], seed).collect()) for seed in (1, 2))
    assert len(a) == 17 and a != b


def test_confusion_from_rates(spark):
    df = spark.createDataFrame([("m", 100, 1000, .3, 45)], "model string, n_attack long, n_rows long, recall double, n_alerts long")
    r = me.confusion_from_rates(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (30, 15, 70, 885) and r.accuracy == pytest.approx(.915)


# -- bootstrap ------------------------------------------------------------------

@pytest.fixture(scope="module")
def grouped(spark):
    r = random.Random(8)
    rows = []
    for i in range(240):
        g = 0 if r.random() < .4 else r.randint(1, 7)
        y = int(r.random() < (.6 if g in (0, 3) else .05))
        rows.append(("m", "val", f"g{g}", y, round(r.random() * .6 + y * .3, 2)))
    return spark.createDataFrame(rows, "model string, split string, group_id string, y int, score double")


def test_weights_equal_concatenating_resampled_rows(spark, grouped):
    keys, n_rep = ["model", "split"], 25
    rows = [r.asDict() for r in grouped.collect()]
    draws = bs.draw_counts(grouped, keys, n_rep).collect()
    per_rep = {}
    for d in draws:
        per_rep.setdefault(d.replicate, {})[d.group_id] = d.weight
    groups = {r["group_id"] for r in rows}
    assert len(per_rep) == n_rep and all(sum(w.values()) == len(groups) for w in per_rep.values())
    areas, f1s = [], []
    for w in per_rep.values():
        cat = [r for r in rows for _ in range(w.get(r["group_id"], 0))]
        y, s = [r["y"] for r in cat], [r["score"] for r in cat]
        if 0 < sum(y) < len(y):
            areas.append(literal_auroc(y, s))
            tp = sum(t and v >= .5 for t, v in zip(y, s))
            f1s.append(2 * tp / (2 * tp + sum((not t) and v >= .5 for t, v in zip(y, s)) + sum(t and v < .5 for t, v in zip(y, s))))
    a = bs.auroc_interval(grouped, keys, n_rep).first()
    assert (a.low, a.high) == pytest.approx((np.percentile(areas, 2.5), np.percentile(areas, 97.5)))
    assert a.point == pytest.approx(literal_auroc([r["y"] for r in rows], [r["score"] for r in rows]))
    assert (a.n_groups, a.n_usable, a.unavailable) == (8, len(areas), None)
    f = bs.f1_interval(grouped.withColumn("threshold", F.lit(.5)), keys, n_rep).first()
    assert (f.low, f.high) == pytest.approx((np.percentile(f1s, 2.5), np.percentile(f1s, 97.5)))


def test_more_replicates_than_lanes_and_any_function(spark, grouped):
    """Replicates beyond one row of weights, and a Python statistic equal to the built-in one."""
    keys, n_rep = ["model", "split"], bs.LANES + 7

    def area(y, score, weight):
        pos, neg = weight * (y == 1), weight * (y == 0)
        if not pos.sum() or not neg.sum():
            return None
        order = (score[:, None] > score).astype(float) + (score[:, None] == score) / 2
        return pos @ order @ neg / (pos.sum() * neg.sum())

    names = ["point", "low", "high", "n_groups", "n_resamples", "n_usable"]
    a, b = bs.auroc_interval(grouped, keys, n_rep).first(), bs.callable_bootstrap(grouped, keys, area, n_rep).first()
    assert [a[c] for c in names] == pytest.approx([b[c] for c in names])
    mean = lambda w: F.sum(w * F.col("score")) / F.sum(w)
    c = bs.cluster_bootstrap(grouped, keys, mean, n_rep).first()
    d = bs.callable_bootstrap(grouped, keys, lambda y, score, weight: (score * weight).sum() / weight.sum(), n_rep).first()
    assert [c[x] for x in names] == pytest.approx([d[x] for x in names]) and c.n_usable == n_rep


def test_draws_are_no_rows_and_pass_no_driver(spark, grouped):
    """Draws are counted in many tasks, in stretches of groups, never exploded to rows nor broadcast; they follow the portable hash."""
    keys, n_rep = ["model", "split"], 1000
    plan = bs.draw_counts(grouped, keys, n_rep)._jdf.queryExecution().executedPlan().toString()
    assert "sequence(1, 1000" not in plan and f", {bs._DRAW_TASKS})" in plan and "SortMergeJoin" in plan
    size, lane = 23, 1
    pairs = spark.range(1, size + 1).select("id", F.explode(F.sequence(F.lit(51), F.lit(57))).alias("r"))
    text = F.concat_ws(":", F.lit("7"), F.col("r").cast("string"), F.col("id").cast("string"))
    number = F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long") % size
    found = {(d.no, d.r): d["count"] for d in pairs.groupBy(number.alias("no"), "r").count().collect()}
    whole = bs._drawn(7, lane, size, 0, size, 57)
    assert {(g, lane * bs.LANES + j + 1): n for (g, j), n in np.ndenumerate(whole) if n} == found
    assert (np.concatenate([bs._drawn(7, lane, size, 0, 10, 57), bs._drawn(7, lane, size, 10, size, 57)]) == whole).all()


def test_draws_are_bytes_shared_by_keys_and_budgets(spark, grouped, monkeypatch):
    """A draw count is a byte; keys with as many groups share the draws; all intervals of a (model, split) take those made once."""
    keys, n_rep = ["model", "split"], 60
    rows = grouped.unionByName(grouped.withColumn("model", F.lit("n"))).unionByName(
        grouped.filter("group_id <> 'g0'").withColumn("model", F.lit("o")))
    lanes = bs._draw_lanes(rows, keys, n_rep, 7)
    assert lanes.schema["_w"].dataType.elementType.typeName() == "byte"
    found = {}
    for r in bs.draw_counts(rows, keys, n_rep, 7).collect():
        found.setdefault(r.model, set()).add((r.replicate, r.group_id, r.weight))
    assert found["m"] == found["n"] != found["o"] and all(sum(w for *_, w in found[x]) == n * n_rep for x, n in (("m", 8), ("o", 7)))

    limits = spark.createDataFrame([(x, b, t) for x in "mno" for b, t in ((.01, .7), (.05, .5))], "model string, budget double, threshold double")
    made, plain = [], bs._draw_lanes
    monkeypatch.setattr(bs, "_draw_lanes", lambda *a: made.append(1) or plain(*a))
    whole = bs.annotate_intervals(rows, limits, n_rep)
    assert len(made) == 1
    alone = bs.f1_interval(rows.join(limits, "model"), [*keys, "budget"], n_rep)
    names = ["model", "budget", "point", "low", "high", "n_groups", "n_usable"]
    assert sorted(whole.filter("statistic = 'f1'").select(names).collect()) == sorted(alone.select(names).collect())
    areas, own = whole.filter("statistic = 'auroc'"), bs.auroc_interval(rows, keys, n_rep)
    assert sorted(areas.select("model", "low", "high").collect()) == sorted(own.select("model", "low", "high").collect())


def test_values_of_replicates_are_made_once(spark, grouped):
    """The point estimate is taken from the pass that gives the replicates."""
    mean = lambda y, score, weight: (score * weight).sum() / weight.sum()
    for out in (bs.auroc_interval(grouped, ["model", "split"], 5), bs.callable_bootstrap(grouped, ["model", "split"], mean, 5)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1


def test_bootstrap_refusals(spark, grouped):
    keys = ["model", "split"]
    one = bs.auroc_interval(grouped.withColumn("group_id", F.lit("x")), keys, 5).first()
    assert one.point is None and one.low is None and "2 groups" in one.unavailable
    flat = bs.auroc_interval(grouped.withColumn("y", F.lit(0)), keys, 5).first()
    assert flat.low is None and "degenerate" in flat.unavailable
    with pytest.raises(ValueError):
        bs.auroc_interval(grouped, keys, 0)
    with pytest.raises(ValueError):
        bs.auroc_interval(grouped, keys, 5, level=1.0)


def test_clusters_are_wider_than_rows(spark):
    rows = [("m", "val", f"g{g}", f"r{g}-{i}", int(g % 2), (g * 7 % 10) / 10) for g in range(10) for i in range(20)]
    df = spark.createDataFrame(rows, "model string, split string, cluster string, row string, y int, score double")
    width = {}
    for c in ("cluster", "row"):
        r = bs.auroc_interval(df.withColumn("group_id", F.col(c)), ["model", "split"], 60).first()
        width[c] = r.high - r.low
    assert width["cluster"] > width["row"]


# -- fusion ---------------------------------------------------------------------

def test_align_refuses_mismatched_members(spark):
    a, b = scores(spark, [0, 1], [.1, .2]), scores(spark, [0, 1], [.3, .4])
    assert fu.align_scores(a, b).count() == 2
    for bad in (scores(spark, [1, 1], [.3, .4]), scores(spark, [0, 1, 0], [.3, .4, .5])):
        with pytest.raises(Exception, match="disagree"):
            fu.align_scores(a, bad).collect()


def test_causal_fusion_ignores_later_rows(spark):
    base = scores(spark, [0, 1, 0], [.1, .2, .3]).withColumn("other", F.col("score"))
    more = base.unionByName(scores(spark, [0] * 5, [.15] * 5, split="test").withColumn("other", F.col("score")))
    pick = lambda df: {r.window_id: r.score for r in fu.causal_fusion(
        df.withColumnRenamed("score", "own"), ["own", "other"]).filter("split = 'val'").collect()}
    assert pick(base) == pick(more) == {0: pytest.approx(1 / 3), 1: pytest.approx(2 / 3), 2: 1.0}


def test_horizon_must_be_whole(spark, grouped):
    for k in (-1, 1.5, True):
        with pytest.raises(ValueError):
            bs.annotate_horizon(grouped, grouped, grouped, GRID, k)


def test_chunks_grow_with_the_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from hostwatch.operators import ordered
    df = spark.range(3000).select((F.col("id") * 7919 % 3001 / 3.0).alias("v"), F.lit(1).alias("n")).dropDuplicates(["v"])
    want = {r.v: i + 1 for i, r in enumerate(df.orderBy("v").collect())}
    for rows in (10 ** 6, 5):
        monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", rows)
        cut = ordered.with_quantile_chunk(df, "v", "c", 8).orderBy("v").collect()
        assert [r.c for r in cut] == sorted(r.c for r in cut) and (len({r.c for r in cut}) > 200) == (rows == 5)
        assert {r.v: r.cum_n for r in ordered.cumulative(df, [], "v", ["n"]).collect()} == want
        assert sorted(r.row_no for r in me.hash_order(df, [], 3, ["v"], rows_per_chunk=rows).collect()) == list(range(1, 3001))


def test_no_shuffle_by_model_or_split_alone(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = scores(spark, [0, 1, 0, 1], [.1, .2, .3, .4]).withColumn("score_b", me.F.col("score"))
        from hostwatch.operators import alerts as al
        from hostwatch.operators import fusion as fu
        t = me.threshold_at_fpr(df, ["model"], (0.1,))
        for out in (fu.rank_fusion(df, ["score", "score_b"], name="f"), al.apply_thresholds(df, t, ["model"]), me.alerts_at(df, t, ["model"], ["budget"])):
            plan = out._jdf.queryExecution().executedPlan().toString()
            # a sort-merge join names its keys first: never one key of few values
            keys = [x.split("[", 1)[1].split("]")[0] for x in plan.splitlines() if "SortMergeJoin" in x]
            assert not [k for k in keys if k.split("#")[0] in ("model", "split") and "," not in k]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rounding_by_arithmetic_equals_spark_round(spark):
    """Ties, large values, NaN and infinities included; the usual values never take the way through decimal text."""
    import random

    from pyspark.sql import functions as F

    from hostwatch.functions.columns import round_half_up
    r = random.Random(3)
    values = [0.0, -0.0, 0.5e-6, -0.5e-6, 1.5e-6, 2.5e-6, 0.1234565, -0.1234565, 1.0000005, 4.35, 1e-300, 1e15, -1e15, 1e300, 1099511.6277765,
              float("nan"), float("inf"), float("-inf"), None]
    values += [r.choice([-1, 1]) * r.random() * 10 ** r.randint(-9, 18) for _ in range(20_000)]
    values += [r.randint(-10 ** 9, 10 ** 9) / 10 ** 7 for _ in range(5_000)] + [r.randint(-10 ** 9, 10 ** 9) / 10 ** 8 + 1e-9 for _ in range(5_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (6, 2):
        plain = F.round("x", places) + F.lit(0.0)
        wrong = df.withColumn("got", round_half_up(F.col("x"), places) + F.lit(0.0)).withColumn("want", plain).filter(~F.expr("got <=> want"))
        assert wrong.collect() == []
