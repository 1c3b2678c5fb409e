from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hostwatch.config import Grid, Settings
from hostwatch.operators import alerts as al
from hostwatch.operators import asof, forecast, sequences

GRID = Grid()
ALERT = "host string, window_id long, window_start long, probability double, stage string, technique string, technique_name string"


def alert(host, w, p, stage="recon"):
    return (host, w, w * 5, p, stage, "T1046", "")


@pytest.fixture(scope="module")
def alerts(spark):
    return spark.createDataFrame([alert("a", 1, .5), alert("a", 2, .9, "impact"), alert("a", 3, .9, "impact"),
                                  alert("b", 2, .9, "recon"), alert("b", 1, .2, "impact")], ALERT)


def test_timeline_ranking_and_best(alerts):
    tl = {r.window_start: (r.host, r.probability) for r in al.network_timeline(alerts).collect()}
    assert tl == {5: ("a", .5), 10: ("a", .9), 15: ("a", .9)}
    rank = [(r.host, r.alerts, r.stage) for r in al.host_ranking(alerts).collect()]
    assert rank == [("a", 3, "impact"), ("b", 2, "impact")]      # stage tie goes to the lowest name
    best = {r.host: r.window_start for r in al.top_alert_per_host(alerts).collect()}
    assert best == {"a": 10, "b": 10}


def test_context_is_bounded_and_ties_are_recent(spark, alerts):
    hist = spark.createDataFrame([("a", w, .4 if w in (0, 1) else .3) for w in range(-60, 4)], "host string, window_id long, p double")
    got = al.top_contributing_windows(hist, alerts.filter("host = 'a' and window_id = 3"), GRID, "p", 240).orderBy("rank").collect()
    assert [(r.context_start, r.seconds_before_alert) for r in got] == [(5, 10), (0, 15), (15, 0)]


def test_flagged_flows_use_start_and_source(spark, alerts):
    s = 1_000_000
    rows = [(7, 5 * s + i, 80, 6, float(i), 0.0, 1, 10.0) for i in range(7)] + [(7, 30 * s, 80, 6, 99.0, 0.0, 1, 1.0), (8, 5 * s, 80, 6, 99.0, 0.0, 1, 1.0)]
    flows = spark.createDataFrame(rows, "src_ip long, start_us long, dst_port int, protocol int, fwd_bytes double, bwd_bytes double, syn int, duration double")
    one = spark.createDataFrame([alert("0.0.0.7", 1, .5)], ALERT)
    got = al.flagged_flows(one, flows, GRID).orderBy("rank").collect()
    assert [r.bytes for r in got] == [6.0, 5.0, 4.0, 3.0, 2.0]


def test_missing_threshold_fails(spark):
    s = spark.createDataFrame([("full", .5), ("flow", .5)], "variant string, score double")
    t = spark.createDataFrame([("full", .4)], "variant string, threshold double")
    assert al.apply_thresholds(s.filter("variant = 'full'"), t, ["variant"]).first().alert
    with pytest.raises(Exception, match="no threshold"):
        al.apply_thresholds(s, t, ["variant"]).collect()


def test_contract_and_privacy(spark, alerts):
    assert al.check_contract(alerts, alerts.columns) is alerts
    with pytest.raises(ValueError, match="stage"):
        al.check_contract(alerts.drop("stage"), alerts.columns)
    with pytest.raises(ValueError):
        al.contract_violations(alerts.drop("stage"))
    hosts = lambda *h: al.hosts_pseudonymised(spark.createDataFrame([(x,) for x in h], "host string")).first().pseudonymised
    assert hosts("ab12") is True and hosts("ab12", "10.0.0.1") is False and hosts() is False


def test_summary_keeps_unknown_apart_from_zero(spark, alerts):
    none = alerts.filter("probability > 2")
    cov = spark.createDataFrame([("ipv6", 3)], "drop_reason string, n long")
    a = al.run_summary(alerts, alerts, none, None, .5, False).first()
    b = al.run_summary(alerts, alerts, none, cov, .5, True).first()
    assert (a.unparsed_frames, a.n_alerts, a.role_features_degraded) == (None, 0, 1)
    assert (b.unparsed_frames, b.role_features_degraded) == (3, 0)


def test_graph_truncation_is_reported(spark, alerts):
    flows = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (4, 5)], "src_ip long, dst_ip long")
    named = alerts.withColumn("host", F.lit("0.0.0.4")).limit(1)
    wf = spark.createDataFrame([("0.0.0.4", 1)], "host string, internal int")
    nodes, edges = al.host_graph(flows, named, wf)
    kept, inner = al.graph_top_nodes(nodes, edges, 3)
    k = kept.collect()
    assert [r.host for r in k] == ["0.0.0.4", "0.0.0.2", "0.0.0.1"] and all(r.truncated and r.total == 5 for r in k)
    assert [(r.src, r.weight) for r in inner.collect()] == [("0.0.0.1", 2)]
    assert {r.src: r.risk for r in edges.collect()}["0.0.0.4"] == .5


def rows(spark, spec):
    return spark.createDataFrame([(h, w, w * 5, i % 2, float(i)) for i, (h, w) in enumerate(spec)],
                                 "host string, window_id long, window_start long, y int, v double")


def test_segments(spark):
    df = rows(spark, [("A", i) for i in range(100)] + [("B", i) for i in range(30)])
    seg = sequences.segment(df, ["v"]).cache()
    assert sorted((r.host, r.segment_no, r.n_real) for r in seg.collect()) == [("A", 0, 48), ("A", 1, 48), ("A", 2, 4), ("B", 0, 30)]
    one = seg.filter("host = 'A' and segment_no = 2").first()
    assert len(one.x) == 48 and one.pad_mask == [False] * 4 + [True] * 44 and one.x[4] == [0.0]
    back = sequences.scatter_back(seg.withColumn("s", F.transform("x", lambda x: x[0])), "s")
    want = {(r.host, r.window_id): r.v for r in df.collect()}
    assert {(r.host, r.window_id): r.score for r in back.collect()} == want
    p = sequences.padding_stats(seg).first()
    assert (p.n_segments, p.full_share) == (4, .5) and p.pad_share == pytest.approx(1 - 130 / 192)


def test_gaps_and_recent(spark):
    df = rows(spark, [("a", 1), ("a", 2), ("a", 2), ("a", 5000), ("b", 7)])
    got = sorted((r.host, r.window_id, r.gap) for r in sequences.gap_features(df).collect())
    assert got == [("a", 1, 1), ("a", 2, 1), ("a", 2, 1), ("a", 5000, 4998), ("b", 7, 1)]
    assert max(r.gap for r in sequences.gap_features(df, clamp=10).collect()) == 10
    seq = {r.host: r for r in sequences.host_sequences(df.filter("window_id <> 2"), ["v"], 3).collect()}
    assert seq["a"].window_ids == [1, 5000] and seq["a"].pad_mask == [False, False, True]
    with pytest.raises(ValueError):
        forecast.source_windows(df, 0)


def test_node_ids_are_a_permutation_that_changes(spark):
    hosts = spark.createDataFrame([(f"h{i}",) for i in range(50)] * 2, "host string")
    ids = [{r.host: r.node_id for r in sequences.epoch_node_ids(hosts, b"k", e).collect()} for e in (0, 0, 1)]
    assert sorted(ids[0].values()) == list(range(50)) and ids[0] == ids[1] != ids[2]


def test_kstep(spark):
    cols = Settings().feature_columns()
    df = rows(spark, [("a", i) for i in range(20)] + [("b", 3)])
    df = df.select("*", *[F.lit(0.0).alias(c) for c in cols])
    fc = forecast.kstep_forecast(forecast.source_windows(df, 12), {4: (F.col("v"), 15.0), 1: (F.col("v") * 0, .5)})
    assert fc.count() == 26 and {r.k: r.seconds_ahead for r in fc.collect()} == {1: 5.0, 4: 20.0}
    curve = {r.host: r.points for r in forecast.per_host_curve(fc).collect()}
    assert [(p.k, p.probability, p.alert) for p in curve["a"]] == [(1, 0.0, False), (4, 19.0, True)]
    assert [r.host for r in forecast.kstep_hosts(fc).collect()] == ["b", "a"]
    assert set(forecast.unavailable_horizons((1, 4, 8), {1: 0, 4: 0})) == {8}


def test_state_as_of_is_strictly_before_the_window_end(spark):
    s = 1_000_000
    flow = lambda start, dur, size: (start * s, 1, 2, 5, 6, dur * 1.0 * s, size, 0.0, 1, 0, 0, 0)
    flows = spark.createDataFrame([flow(0, 14, 1.0), flow(1, 14, 2.0), flow(2, 30, 3.0)],
                                  "start_us long, src_ip long, dst_ip long, src_port int, dst_port int, duration double, "
                                  "fwd_bytes double, bwd_bytes double, fwd_pkts long, bwd_pkts long, syn int, rst int")
    ro = spark.createDataFrame([("0.0.0.2", 0), ("0.0.0.2", 1), ("0.0.0.2", 900), ("9.9.9.9", 0)], "host string, window_id long")
    got = {(r.host, r.window_id): r.bytes for r in asof.host_state_asof(ro, flows, GRID, chunk_us=20 * s).collect()}
    assert got == {("0.0.0.2", 0): 1.0, ("0.0.0.2", 1): 2.0, ("0.0.0.2", 900): 3.0, ("9.9.9.9", 0): 0.0}
    mean = {(r.host, r.window_id): (r.n_flows, r.mean_bytes) for r in asof.neighbour_agg(ro, flows, GRID).collect()}
    assert mean == {("0.0.0.2", 0): (1, 1.0), ("0.0.0.2", 1): (2, 1.5), ("0.0.0.2", 900): (0, 0.0), ("9.9.9.9", 0): (0, 0.0)}
