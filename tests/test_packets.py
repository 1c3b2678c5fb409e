from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hostwatch.config import PACKET_FIELDS, SENT_FIELDS, Grid
from hostwatch.operators import packets as pk
from hostwatch.operators.windows import build_window_features, finish_features, mask_flow_only
from hostwatch.config import Settings
from tests.conftest import by_key, packet, packets
from tests.explosion import packet_window_features_exploded

GRID = Grid()


def random_packets(spark, n=3000, seed=5, span_s=200):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        src = 1 if r.random() < 0.4 else r.randint(2, 6)          # one source holds a large share
        t = 1_500_000_000_000_000 + r.randrange(span_s * 20) * 50_000   # many equal timestamps
        rows.append(packet(i, t, src, r.randint(1, 9), r.choice([22, 4000, 443]), r.randint(1, 12),
                           r.choice([6, 6, 17]), r.randint(1, 255), r.randint(0, 65535), int(r.random() < .1),
                           r.choice([0, 63, 64, 511, 1459, 1460, 8191, 8192, 60000]), int(r.random() < .05),
                           int(r.random() < .3), int(r.random() < .5)))
    return packets(spark, rows)


@pytest.mark.parametrize("sub_us", [None, 5_000_000, 250_000])
def test_bins_equal_row_explosion(spark, sub_us):
    p = random_packets(spark)
    got = by_key(pk.packet_window_features(p, GRID, sub_us), "src_ip", "window_id")
    want = by_key(packet_window_features_exploded(p, GRID), "src_ip", "window_id")
    assert got.keys() == want.keys() and len(got) > 100
    for key, row in want.items():
        for f in PACKET_FIELDS:
            assert got[key][f] == pytest.approx(row[f], abs=1e-9, rel=1e-9), (key, f)


def test_one_pass_equals_merging_the_families(spark):
    p = random_packets(spark, 800, 9)
    merged = by_key(pk.merge_features(pk.packet_window_features(p, GRID), pk.sent_window_features(p, GRID)), "src_ip", "window_id")
    both = by_key(pk.all_window_features(p, GRID), "src_ip", "window_id")
    assert both.keys() == merged.keys()
    for key in merged:
        for f in (*PACKET_FIELDS, *SENT_FIELDS):
            assert both[key][f] == pytest.approx(merged[key][f]), (key, f)


def test_sequential_step_across_sparse_bins(spark):
    # ports 5 then 6, ten seconds apart: only the one window holding both sees the step
    p = packets(spark, [packet(0, 20_000_000, dport=5), packet(1, 30_000_000, dport=6)])
    got = by_key(pk.packet_window_features(p, GRID), "window_id")
    assert {w[0]: r["sequential_port_ratio"] for w, r in got.items()} == {2: 0.0, 3: 0.0, 4: 1.0, 5: 0.0, 6: 0.0}


def test_negative_times_and_window_count(spark):
    got = pk.assign_windows(packets(spark, [packet(0, -1)]), GRID)
    assert sorted(r.window_id for r in got.collect()) == [-3, -2, -1]


def test_window_bounded_total(spark):
    """Every packet counts in exactly three windows, never as a whole-flow total."""
    p = random_packets(spark, 500, 3)
    total = pk.sent_window_features(p, GRID).agg(F.sum("sent_pkts")).first()[0]
    assert total == 3 * 500


def test_retransmissions(spark):
    rows = [packet(0, 0, seq=7, size=10), packet(1, 10, seq=7, size=10), packet(2, 20, seq=7, size=11),
            packet(3, 30, seq=7, size=0), packet(4, 40, seq=7, size=0),                 # bare ACKs never count
            packet(5, 50, seq=7, size=0, syn=1), packet(6, 60, seq=7, size=0, syn=1),
            packet(7, 70, seq=7, size=10, frag=1), packet(8, 80, seq=7, size=10, proto=17)]
    got = {r.packet_no: r.is_retrans for r in pk.mark_retransmissions(packets(spark, rows)).collect()}
    assert [n for n, v in sorted(got.items()) if v] == [1, 6]


def test_feature_order_and_unknown_role():
    assert len(Settings().feature_columns()) == 30
    assert Settings(role_fields=("internal",)).feature_columns()[-1] == "internal"
    with pytest.raises(ValueError):
        Settings(role_fields=("typo",)).feature_columns()


def test_roles_without_key_are_zero_and_mask(spark):
    p = packets(spark, [packet(0, 0, src=167772161)])
    row = build_window_features(p).first()
    assert (row["host"], row["internal"], row["net24_bucket"]) == ("10.0.0.1", 0, 0)
    keyed = build_window_features(p, key=b"k")
    assert keyed.first()["internal"] == 1
    assert mask_flow_only(keyed).first()["ttl_mean"] == 0.0
    with pytest.raises(RuntimeError):
        finish_features(pk.all_window_features(p, GRID), Settings(), None, pseudonyms=True)
    hidden = build_window_features(p, key=b"k", pseudonyms=True).first()
    assert "." not in hidden["host"] and hidden["internal"] == 1
