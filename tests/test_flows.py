from __future__ import annotations

import random

import pytest

from hostwatch.config import Grid
from hostwatch.operators import flows as fl
from tests.conftest import packet, packets

S = 1_000_000
GRID = Grid()


def test_conversation_direction_and_stats(spark):
    rows = [packet(0, 0, 9, 5, 4000, 80, syn=1, win=100), packet(1, 1 * S, 5, 9, 80, 4000, syn=1, ack=1, win=200),
            packet(2, 3 * S, 9, 5, 4000, 80, size=50), packet(3, 4 * S, 5, 9, 80, 4000, size=70)]
    f = fl.assemble_flows(packets(spark, rows)).collect()
    assert len(f) == 1
    r = f[0]
    assert (r.src_ip, r.dst_ip, r.src_port, r.dst_port) == (9, 5, 4000, 80)
    assert (r.fwd_pkts, r.bwd_pkts, r.fwd_bytes, r.bwd_bytes) == (2, 2, 50.0, 70.0)
    assert (r.init_win_fwd, r.init_win_bwd, r.duration) == (100, 200, 4.0 * S)
    assert (r.iat_mean, r.iat_max) == (pytest.approx(4 * S / 3), 2.0 * S)
    assert r.iat_std == pytest.approx((2 / 9) ** 0.5 * S)
    assert r.label == "unlabeled"


def test_gap_of_exactly_the_timeout_merges(spark):
    same = packets(spark, [packet(0, 0), packet(1, 120 * S)])
    split = packets(spark, [packet(0, 0), packet(1, 120 * S + 1)])
    assert fl.assemble_flows(same).count() == 1
    assert fl.assemble_flows(split).count() == 2


def test_missing_syn_and_self_flow(spark):
    r = fl.assemble_flows(packets(spark, [packet(0, 0, 7, 7, 5, 5), packet(1, S, 7, 7, 5, 5)])).first()
    assert (r.fwd_pkts, r.bwd_pkts, r.init_win_fwd, r.init_win_bwd) == (2, 0, -1, -1)


def test_chunking_does_not_change_flows(spark):
    r = random.Random(2)
    rows = []
    for i in range(1500):
        a, b = (1, 2) if r.random() < 0.6 else (r.randint(1, 4), r.randint(1, 4))
        rows.append(packet(i, r.randrange(4000) * S // 2, a, b, r.choice([10, 11]), r.choice([10, 11]), size=r.randint(0, 9)))
    p = packets(spark, rows)
    cols = ["start_us", "src_ip", "dst_ip", "src_port", "dst_port", "duration", "fwd_bytes", "bwd_bytes", "iat_mean", "iat_std"]
    runs = [sorted(tuple(round(x, 3) for x in row) for row in fl.assemble_flows(p, 30, c).select(*cols).collect())
            for c in (10 * S, 10_000 * S)]
    assert runs[0] == runs[1] and len(runs[0]) > 50


FLOW = ("start_us long, src_ip long, dst_ip long, src_port int, dst_port int, duration double, fwd_bytes double, fwd_pkts long, "
        "syn int, ack int, fin int, rst int, psh int, urg int, init_win_fwd int")


def flow(start, dur, size=100.0, win=-1, dst=2):
    return (start, 1, dst, 443, 80, dur, size, 4, 1, 0, 0, 0, 0, 0, win)


def test_long_flow_is_spread_not_dumped(spark):
    w = fl.flows_to_windows(spark.createDataFrame([flow(100 * S, 40.0 * S, 40000.0)], FLOW), GRID)
    sizes = [r.sent_bytes for r in w.collect()]
    assert max(sizes) < 20000 and sum(sizes) == pytest.approx(3 * 40000)


@pytest.mark.parametrize("dur", [0.0, None, float("nan"), float("inf"), -5.0])
def test_untimed_flow_counts_in_full(spark, dur):
    w = fl.flows_to_windows(spark.createDataFrame([flow(7 * S, dur)], FLOW), GRID)
    assert sorted((r.window_id, r.sent_bytes) for r in w.collect()) == [(-1, 100.0), (0, 100.0), (1, 100.0)]


def test_sentinel_window(spark):
    df = spark.createDataFrame([flow(0, 0.0, win=-1), flow(0, 0.0, win=99)], FLOW)
    assert fl.flows_to_windows(df, GRID).filter("window_id = 0").first().syn_win_mean == 99.0
    assert fl.flows_to_windows(df, GRID, average_sentinel=True).filter("window_id = 0").first().syn_win_mean == 49.0


def exploded(flows, grid):
    """A row for every (flow, window): the plain form of the spread."""
    out = {}
    for f in flows:
        timed = f[5] is not None and 0 < f[5] < float("inf")
        first = f[0] // grid.stride_us - grid.n_bins - 1
        last = (f[0] + int(f[5]) if timed else f[0]) // grid.stride_us + 1
        for w in range(first, last + 1):
            a, b = w * grid.stride_us, w * grid.stride_us + grid.window_us
            share = (min(f[0] + int(f[5]), b) - max(f[0], a)) / f[5] if timed else float(a <= f[0] < b)
            if share > 0:
                out.setdefault((f[1], w), []).append((share, f))
    return out


def test_spread_equals_a_row_per_window(spark):
    r = random.Random(5)
    rows = []
    for _ in range(300):
        dur = r.choice([0.0, None, float("nan"), 0.4, 3.0 * S, 14.9 * S, 15.0 * S, 20.0 * S, 61.0 * S, 700.5 * S, 90_000.0 * S])
        rows.append((r.randrange(2000) * S // 2, r.randint(1, 3), r.randint(1, 4), r.choice([443, 5000]), 80, dur, r.random() * 1e6,
                     r.randint(1, 50), r.randint(0, 1), 0, 0, 0, 1, 0, r.choice([-1, 100, 9000])))
    got = {(x.src_ip, x.window_id): x for x in fl.flows_to_windows(spark.createDataFrame(rows, FLOW), GRID).collect()}
    want = exploded(rows, GRID)
    assert got.keys() == want.keys()
    for key, own in want.items():
        x, wins = got[key], [f[14] for _, f in own if f[14] >= 0]
        assert x.sent_bytes == pytest.approx(sum(s * f[6] for s, f in own), abs=1e-6) and x.psh == pytest.approx(sum(s for s, _ in own))
        assert x.sent_pkts == pytest.approx(sum(s * f[7] for s, f in own), abs=1e-6) and x.distinct_dst_ips == len({f[2] for _, f in own})
        assert x.syn_win_mean == pytest.approx(sum(wins) / len(wins) if wins else 0)
        assert x.server_port_ratio == pytest.approx(sum(f[3] == 443 for _, f in own) / len(own))


def test_year_long_flow(spark):
    year = 365 * 86400.0 * S
    w = fl.flows_to_windows(spark.createDataFrame([flow(100 * S, year, 1e9), flow(100 * S + int(year) // 2, 5.0 * S, dst=3)], FLOW), GRID)
    from pyspark.sql import functions as F
    n, size, most, ids = w.agg(F.count("*"), F.sum("sent_bytes"), F.max("distinct_dst_ips"), F.count_distinct("window_id")).first()
    assert n == ids == 365 * 86400 // 5 + 2 and most == 2 and size == pytest.approx(3 * (1e9 + 100))


def test_flows_are_spread_after_the_shuffle(spark, tmp_path):
    """Flows are shuffled, not their windows: rows of single windows are made and summed in one task."""
    spark.createDataFrame([flow(7 * S, 61.0 * S)], FLOW).write.parquet(str(tmp_path / "f"))
    plan = fl.flows_to_windows(spark.read.parquet(str(tmp_path / "f")), GRID)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Exchange")]
    assert "Generate explode(sequence(_first" in above and "HashAggregate" in above


def test_packets_are_shuffled_once(spark, tmp_path):
    """One exchange carries packets, one their summaries; nothing is joined."""
    packets(spark, [packet(0, 0), packet(1, S)]).write.parquet(str(tmp_path / "p"))
    plan = fl.assemble_flows(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan and plan.count("FileScan") == 1


def test_role_features(spark):
    ten = 167772160
    rows = [(ten + 1, ten + 2, 22, 5000), (ten + 1, ten + 2, 6000, 22), (ten + 3, ten + 1, 1, 443), (ten + 3, ten + 1, 1, 80)]
    df = spark.createDataFrame(rows, "src_ip long, dst_ip long, src_port int, dst_port int")
    got = {r.host: r for r in fl.role_features(df, b"k").collect()}
    assert got["10.0.0.1"].server_port_ratio == 0.75 and got["10.0.0.1"].internal == 1


def test_flow_window_features_hash_networks_once_and_skip_empty_steps(spark):
    """The keyed hash is taken per /24 network, not in every row; without long flows nothing looks for steps of them."""
    from pyspark.sql import functions as F

    from hostwatch.operators.windows import add_roles, network_buckets
    from hostwatch.plans.queries import flow_window_features
    from hostwatch.plans.views import GRID, KEY, Views
    rows = spark.createDataFrame([(x,) for x in (167772160, 167772161, 3405803776, 2 ** 33 + 5, 5, 0, -1, None, None)], "src_ip long")
    want = add_roles(rows, KEY)
    got = add_roles(rows, KEY, networks=network_buckets(rows, KEY)).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))

    plan = flow_window_features(Views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan

    def flow(hours):
        return (1, 2, 0, hours * 3_600_000_000.0, *[1.0] * 2, *[0] * 6, 7, 443)
    names = "src_ip long, dst_ip long, start_us long, duration double, fwd_bytes double, fwd_pkts double, syn int, ack int, fin int, rst int, " \
            "psh int, urg int, init_win_fwd int, src_port int"
    for hours, sorts, windows in ((5, 1, 5), (200, 3, 102)):
        out = fl.flows_to_windows(spark.createDataFrame([flow(hours)], names), GRID)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == sorts
        assert out.agg(F.min("distinct_dst_ips"), F.max("distinct_dst_ips"), F.count("*")).first() == (1, 1, windows)
    nothing = fl.flows_to_windows(spark.createDataFrame([], names), GRID)
    assert nothing.count() == 0
