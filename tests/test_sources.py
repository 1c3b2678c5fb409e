from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hostwatch.config import DROP_REASONS, FLOW_COLUMNS
from hostwatch.functions import net
from hostwatch.functions.rules import infer_stage, map_technique
from hostwatch.functions.times import local_to_epoch, parse_timestamp
from hostwatch.sources import flow_csv, frames, operator_log, stores

HEAD = list(FLOW_COLUMNS.values())


def line(ts="20/02/2018 08:34:07", size="10", iat="5", label="Benign"):
    values = {"Timestamp": ts, "Src IP": "10.0.0.1", "Dst IP": "10.0.0.2", "TotLen Fwd Pkts": size, "Flow IAT Mean": iat, "Label": label}
    return ",".join(values.get(h, "1") for h in HEAD)


def write(tmp_path, name, header, rows):
    p = tmp_path / name
    p.write_text("\n".join([header, *rows]) + "\n")
    return str(p)


def test_defects_load_identically(spark, tmp_path):
    body = [line(size=str(i)) for i in range(20)]
    clean = flow_csv.read_flow_csv(spark, write(tmp_path, "a.csv", ",".join(HEAD), body))
    dirty = flow_csv.read_flow_csv(spark, write(
        tmp_path, "b.csv", ",".join(f" {h} " for h in HEAD),
        body[:7] + [",".join(HEAD)] + body[7:] + [",".join(HEAD)]))
    assert clean.schema == dirty.schema and clean.exceptAll(dirty).isEmpty() and dirty.count() == 20


def test_numeric_adoption_and_infinity(spark, tmp_path):
    rows = [line(iat="Infinity"), line(iat="NaN"), *[line(iat="2") for _ in range(8)]]
    df = flow_csv.read_flow_csv(spark, write(tmp_path, "c.csv", ",".join(HEAD), rows))
    assert dict(df.dtypes)["Flow IAT Mean"] == "double" and df.agg(F.count("`Flow IAT Mean`")).first()[0] == 8
    rows = [line(iat="x"), line(iat="y"), *[line(iat="2") for _ in range(8)]]
    df = flow_csv.read_flow_csv(spark, write(tmp_path, "d.csv", ",".join(HEAD), rows))
    assert dict(df.dtypes)["Flow IAT Mean"] == "string"


def test_numeric_cells_without_failed_casts(spark, tmp_path):
    """a cell counts as a number where the cast gives one; cells that are surely none are not cast."""
    texts = ["1", "-1.5", "+2", ".5", "5.", "1e5", "1E-400", "1e400", "0x1p3", "1d", "1F", "inf", "-Infinity", "nan", "NaN", "1..2", "1.2.3",
             "10.0.0.1", "03/02/2018 01:00:00 PM", "Attack", "e", "d", "-", "", "1,2", "1 2", "\u0661", "\u00a01", "9" * 301, " 1\n", None]
    value = F.col("t").try_cast("double")
    cast = F.coalesce(value.isNotNull() & ~F.isnan(value), F.lit(False))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cast.alias("a"), flow_csv.is_number(F.col("t")).alias("b"))
    assert [r.t for r in rows.collect() if r.a != r.b] == []
    empty = flow_csv.read_flow_csv(spark, write(tmp_path, "g.csv", ",".join(HEAD), []))
    assert {t for _, t in empty.dtypes} == {"string"} and empty.isEmpty()


def test_canonical(spark, tmp_path):
    rows = [line(ts="03/02/2018 01:00:00 PM"), line(ts="3/2/2018 1:05"), line(ts="2018-02-03 02:00:00")]
    raw = flow_csv.read_flow_csv(spark, write(tmp_path, "e.csv", ",".join(HEAD), rows))
    out = flow_csv.to_canonical(raw, ordered=True)
    assert [str(r.timestamp) for r in out.collect()] == ["2018-02-03 01:05:00", "2018-02-03 02:00:00", "2018-02-03 13:00:00"]
    assert set(FLOW_COLUMNS) <= set(out.columns) and len(flow_csv.numeric_columns()) == 19
    with pytest.raises(ValueError, match="Src IP"):
        flow_csv.to_canonical(raw.drop("Src IP"))
    with pytest.raises(ValueError, match="Label"):
        flow_csv.read_flow_csv(spark, write(tmp_path, "f.csv", "a,b", ["1,2"]))


def test_operator_log(spark, tmp_path):
    good = ["session_id\tx", "# columns", "", "benign\t10:00:00\t10:01:00\t1.1.1.1\t2.2.2.2",
            "recon\t10:02:10\t10:03:00\t203.0.113.7\t10.0.0.1"]
    path = write(tmp_path, "log.txt", good[0], good[1:])
    row = operator_log.read_operator_log(spark, path, "2025-10-09").first()
    assert (row.stage, row.end_s - row.start_s, row.hosts) == ("recon", 50, ["203.0.113.7", "10.0.0.1"])
    for bad, why in (("recon\t1\t2", "2 or 5 fields"), ("odd\t10:00:00\t10:01:00\ta\tb", "unknown stage"),
                     ("recon\t10:01:00\t10:01:00\ta\tb", "before it starts"), ("recon\t10:00:00\t10:01:00\t\t", "no host")):
        with pytest.raises(Exception, match=why):
            operator_log.read_operator_log(spark, write(tmp_path, "bad.txt", good[0], [bad]), "2025-10-09").collect()
    with pytest.raises(Exception, match="outside"):
        operator_log.read_operator_log(spark, path, "2025-10-09", (0, 10)).collect()


def test_frames(spark):
    eth = "00" * 12
    ip = lambda total, frag, proto: f"4500{total:04x}0000{frag:04x}40{proto:02x}00000a0000010a000002"
    tcp = "03e80050" + "00000007" + "00000000" + "5012" + "2000" + "00000000"
    rows = [("tcp", eth + "0800" + ip(45, 0, 6) + tcp), ("vlan", eth + "81000001" + "0800" + ip(40, 0, 6) + tcp),
            ("udp", eth + "0800" + ip(30, 0, 17) + "0035003500000000"), ("first", eth + "0800" + ip(40, 0x2000, 6) + tcp),
            ("later", eth + "0800" + ip(40, 5, 6) + tcp), ("v6", eth + "86dd" + "00" * 30), ("arp", eth + "0806" + "00" * 30),
            ("short", "00" * 20), ("cut", eth + "81000001" + "0800" + "00" * 17)]
    df = spark.createDataFrame([(i, i, bytearray.fromhex(h)) for i, (_, h) in enumerate(rows)], "frame_no long, ts_us long, raw binary")
    got = {r.packet_no: r for r in frames.decode_frames(df).collect()}
    t = got[0]
    assert (t.src_ip, t.dst_ip, t.src_port, t.dst_port, t.ttl, t.tcp_win, t.payload_len, t.syn, t.ack, t.fin, t.seq) == (
        167772161, 167772162, 1000, 80, 64, 8192, 5, 1, 1, 0, 7)
    assert (got[1].dst_port, got[1].payload_len, got[1].is_frag) == (80, 0, 0)
    assert (got[2].src_port, got[2].payload_len, got[2].tcp_win) == (53, 2, 0)
    assert (got[3].is_frag, got[3].dst_port) == (1, 80)
    assert (got[4].is_frag, got[4].dst_port, got[4].payload_len, got[4].syn) == (1, 0, 20, 0)
    cov = {r.drop_reason: r.n for r in frames.frame_coverage(df).collect()}
    assert cov == {"ipv6": 1, "non_ipv4_ethertype": 1, "short_frame": 1, "truncated_ip_header": 1}
    unknown = frames.frame_coverage(None, spark).collect()
    assert len(unknown) == len(DROP_REASONS) and all(r.n is None for r in unknown)


def test_stores(spark, tmp_path):
    path = str(tmp_path / "features")
    df = spark.createDataFrame([("2018-02-14", "c1", 1), ("2018-02-14", "c2", 2), ("2018-02-16", "c1", 3)], "day string, capture_id string, v int")
    stores.write_features(df, path)
    stores.write_features(df.filter("capture_id = 'c2'").withColumn("v", F.lit(20)), path)     # replaces its own partition only
    assert sorted(r.v for r in stores.read_features(spark, path, ["2018-02-14"]).collect()) == [1, 20]
    with pytest.raises(FileNotFoundError):
        stores.read_features(spark, path, ["2018-02-14", "2018-03-02"])
    wanted = df.select("day", "capture_id").unionByName(spark.createDataFrame([("2018-02-16", "c9")], "day string, capture_id string"))
    assert [r.capture_id for r in stores.missing_captures(wanted, spark, path).collect()] == ["c9"]
    res = tmp_path / "results"
    res.mkdir()
    for name, text in (("a", '{"model":"lr","test":{"auroc":0.5}}'), ("b", '{"model":"lr","test":{"auroc":0.9}}'),
                       ("c", '{"model":"lr__x","test":{"auroc":0.9}}'), ("d", '{"model":"forecast","horizons":{"1":2}}')):
        (res / f"{name}.json").write_text(text)
    got = stores.read_results(spark, str(res)).collect()
    assert [(r.model, r.test.auroc) for r in got] == [("lr", 0.5)]


def test_sampling(spark):
    hosts = spark.createDataFrame([("d", f"h{i}") for i in range(20)], "day string, host string")
    tl = spark.createDataFrame([("d", "h3"), ("d", "gone")], "day string, host string")
    got = operator_log.sample_hosts(hosts, tl, 5).collect()
    assert sorted(r.reason for r in got) == ["sampled"] * 5 + ["timeline"] and "h3" in {r.host for r in got}
    with pytest.raises(ValueError, match="gone"):
        operator_log.require_victims(hosts, tl)


def test_addresses_and_times(spark):
    df = spark.createDataFrame([("172.31.69.25",), ("172.32.0.1",), ("10.255.0.1",), ("192.168.1.1",), ("8.8.8.8",)], "t string")
    rows = df.select("t", net.is_internal(net.text_to_ip("t")).alias("i"), net.ip_to_text(net.text_to_ip("t")).alias("b"),
                     net.looks_like_ip("t").alias("l")).collect()
    assert [r.i for r in rows] == [True, False, True, True, False] and all(r.t == r.b and r.l for r in rows)
    odd = spark.createDataFrame([("deadbeefdeadbeef", "2018-02-14", "10:32"), ("fe80::1", "2018-02-14", "00:00:05")], "h string, d string, t string")
    got = odd.select(net.looks_like_ip("h").alias("l"), local_to_epoch("d", "t", 4).alias("e")).collect()
    assert [r.l for r in got] == [False, True] and [r.e for r in got] == [1518618720, 1518580800 + 4 * 3600 - 14400 + 5]
    assert spark.range(1).select(parse_timestamp(F.lit("rubbish"))).first()[0] is None


FEATS = "sent_bytes double, distinct_dst_ips long, syn long, distinct_dst_ports long, sequential_port_ratio double, ack long, sent_pkts long, internal int"


@pytest.mark.parametrize("row, stage, technique", [
    ((50001.0, 2, 9, 50, 1.0, 0, 900, 1), "exfiltration", "T1048"),
    ((50000.0, 2, 9, 21, 0.0, 0, 900, 0), "recon", "T1046"),
    ((0.0, 1, 0, 1, 0.6, 0, 9, 1), "lateral_movement", "T1046"),
    ((0.0, 1, 31, 1, 0.5, 30, 9, 1), "initial_access", "T1110"),
    ((0.0, 1, 31, 1, 0.0, 31, 501, 1), "impact", "T1498"),
    ((0.0, 1, 30, 20, 0.5, 0, 500, 1), "unclassified", None),
])
def test_stage_rules(spark, row, stage, technique):
    df = spark.createDataFrame([row], FEATS).withColumn("stage", infer_stage())
    got = df.select("stage", map_technique("stage")["technique"].alias("t")).first()
    assert (got.stage, got.t) == (stage, technique)


def test_technique_map_refusals(spark):
    df = spark.createDataFrame([("recon", 1.0)], "stage string, syn double")
    with pytest.raises(ValueError):
        map_technique("stage", techniques={"recon": ("T", "", (({}, "T", ""),))})
    with pytest.raises(ValueError):
        map_technique("stage", techniques={"recon": ("T", "", (({"syn_gte": 1}, "T", ""),))})
    with pytest.raises(KeyError):
        map_technique("stage", techniques={"recon": ("T", "", (({"syn_gt": "stage_rule:none"}, "T", ""),))})
    with pytest.raises(Exception, match="without technique entry"):
        df.select(map_technique("stage", techniques={"benign": (None, "", ())})).collect()
    absent = df.select(map_technique("stage", techniques={"recon": ("D", "", (({"gone_gt": 0}, "T", ""),))}, available={"syn"})["technique"])
    assert absent.first()[0] == "D"
