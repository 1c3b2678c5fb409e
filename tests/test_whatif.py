"""Golden figures of a six-host kill chain, and invariants of every transform."""

from __future__ import annotations

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostwatch.config import Settings
from hostwatch.operators import whatif as wi

A, B = 203 * 2**24 + 113 * 2**8 + 7, 10 * 2**24 + 20 * 2**16 + 10          # 203.0.113.7, 10.20.0.10
C = 10 * 2**24 + 20 * 2**16 + 20                                           # 10.20.0.20
BENIGN = [10 * 2**24 + 20 * 2**16 + n for n in (31, 32, 33)]
BASE = 1_760_000_000_000_000


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    def phase(n, order, t, src, dst, sport, dport, flags, size):
        i = F.col("i").cast("long")
        lit = lambda x: x(i) if callable(x) else F.lit(x)
        return spark.range(n).select(F.col("id").alias("i")).select(
            (F.lit(order * 100_000) + i).alias("order"), lit(t).cast("long").alias("ts_us"), lit(src).cast("long").alias("src_ip"),
            lit(dst).cast("long").alias("dst_ip"), lit(sport).cast("int").alias("src_port"), lit(dport).cast("int").alias("dst_port"),
            F.lit(flags).alias("flags"), F.lit(size).cast("long").alias("payload_len"))

    benign = lambda k: F.element_at(F.array(*[F.lit(x) for x in BENIGN]), (k % 3 + 1).cast("int"))
    sec = lambda i: F.floor(i * 1.5)
    parts = [
        phase(80, 0, lambda i: i * 1_500_000, lambda i: benign(sec(i)), B, lambda i: 40000 + sec(i) % 2000, 80, "PA", 16),
        phase(80, 1, lambda i: i * 1_500_000 + 20_000, B, lambda i: benign(sec(i)), 80, lambda i: 40000 + sec(i) % 2000, "PA", 407),
        phase(800, 2, lambda i: 130_000_000 + i * 70_000, A, B, 55000, lambda i: i + 1, "S", 0),
        phase(700, 3, lambda i: 200_000_000 + i * 80_000, A, B, lambda i: 56000 + i % 500, 22, "S", 0),
        phase(700, 4, lambda i: 200_010_000 + i * 80_000, A, B, lambda i: 56000 + i % 500, 22, "PA", 35),
        phase(200, 5, lambda i: 270_000_000 + i * 250_000, B, C, 57000, lambda i: 20 + i, "S", 0),
        phase(3000, 6, lambda i: 330_000_000 + i * 20_000, B, A, 58000, 4444, "PA", 1400),
        phase(60, 7, lambda i: 395_000_000 + i * 1_000_000, lambda i: benign(i), B, lambda i: 41000 + i, 80, "PA", 5),
    ]
    df = reduce(DataFrame.unionByName, parts)
    flag = lambda f: F.col("flags").contains(f).cast("int")
    df = df.select(
        F.col("order").alias("packet_no"), (F.lit(BASE) + F.col("ts_us")).alias("ts_us"), "src_ip", "dst_ip", "src_port",
        "dst_port", F.lit(6).alias("protocol"), F.lit(64).alias("ttl"), F.lit(8192).alias("tcp_win"), F.lit(0).alias("is_frag"),
        "payload_len", F.lit(0).alias("is_retrans"), flag("S").alias("syn"), flag("A").alias("ack"), F.lit(0).alias("fin"),
        F.lit(0).alias("rst"), flag("P").alias("psh"), F.lit(0).alias("urg"))
    path = str(tmp_path_factory.mktemp("killchain"))
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)



def senders(packets, *addresses):
    return packets.sparkSession.createDataFrame([(a,) for a in addresses], "src_ip long")


STAGES = ["benign", "recon", "initial_access", "lateral_movement", "c2", "exfiltration", "impact", "unclassified"]
GOLDEN = {
    "baseline": (389.96, 5480, 4257060, 1081, 1581, 80, 1.0, 750, 1050000, [0, 14, 0, 29, 0, 14, 0, 23]),
    "pace_5x": (1949.8, 5480, 4257060, 1081, 1581, 353, 1.0, 150, 210000, [0, 58, 0, 132, 0, 62, 0, 101]),
    "pace_15x": (5849.4, 5480, 4257060, 1081, 1581, 916, 1.0, 50, 70000, [0, 170, 0, 151, 0, 178, 0, 417]),
    "pad_payload": (389.96, 11480, 4257060, 1081, 1581, 80, 1.0, 2250, 1050000, [0, 14, 0, 29, 0, 14, 0, 23]),
}


def test_golden_figures_and_invariants(packets):
    assert packets.count() == 5620
    got = {r.variant: r for r in wi.evasion_table(packets, senders(packets, A, B), Settings()).collect()}
    for name, (span, pkts, size, reach, sockets, wins, seq, peak_p, peak_b, stages) in GOLDEN.items():
        r = got[name]
        assert r.span_s == pytest.approx(span)
        assert (r.pkts, r.bytes, r.reach, r.sockets, r.windows) == (pkts, size, reach, sockets, wins), name
        assert (r.seq_ratio, r.peak_pkts, r.peak_bytes) == (seq, peak_p, peak_b), name
        assert [r[f"stage_{s}"] for s in STAGES] == stages, name
    plain, padded = ([got[n][f"hist_{i}"] for i in range(8)] for n in ("baseline", "pad_payload"))
    assert plain == [7200, 0, 0, 240, 0, 9000, 0, 0] and padded == [7200, 0, 0, 27240, 0, 0, 0, 0]
    # every variant delivers the identical campaign
    assert len(got) == 8 and {(r.bytes, r.reach, r.sockets) for r in got.values()} == {(4257060, 1081, 1581)}
    assert got["baseline"].ttl_var == 0 and got["ttl_random"].ttl_var > 50 and got["win_random"].win_var > 1e8
    # the draw itself is free; what matters is that the sequential rule (0.5) stops firing
    assert got["port_random"].seq_ratio < 0.5 and got["combined"].pkts == 11480
    assert [got["ttl_random"][f"stage_{s}"] for s in STAGES] == GOLDEN["baseline"][-1]


def test_only_attacker_rows_change(packets):
    for step in wi.TRANSFORMS.values():
        out = step(packets, senders(packets, A))
        mine = lambda d: d.filter(F.col("src_ip") != A).drop("packet_no")
        assert mine(out).exceptAll(mine(packets)).isEmpty() and mine(packets).exceptAll(mine(out)).isEmpty()


def test_refusals(packets):
    with pytest.raises(Exception, match="sent a packet"):
        wi.evasion_table(packets, senders(packets, 1), Settings(), ("baseline",)).collect()
    with pytest.raises(Exception, match="cannot land"):   # 1460 halves to 730, below bin 5's 1024
        wi.rechunk_payload(packets.withColumn("payload_len", F.lit(1460).cast("long")), senders(packets, A), 5).agg(
            F.sum("payload_len")).collect()
    with pytest.raises(ValueError):
        wi.rechunk_payload(packets, senders(packets, A), 7)
    with pytest.raises(ValueError):
        wi.apply_variant(packets, senders(packets, A), "nope")
    with pytest.raises(ValueError):
        wi.randomise_header(packets, senders(packets, A), "seq", 0, 1)
