"""Views that bind the driver tables to the roles the operators expect.

Hosts, ports and sizes are integer functions of the ``events`` and ``lineitem``
rows, so the same view can be written once here and once as SQL.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STAGES, Grid, Settings
from ..functions.columns import epoch_us, floor_div
from ..functions.net import ip_to_text, is_internal
from ..operators import flows as FL
from ..operators import labels as LB
from ..operators import packets as PK
from ..operators import windows as WN
from .staging import input_fingerprint, staged, staged_path

INTERNAL_BASE = 167772160      # 10.0.0.0
EXTERNAL_BASE = 3405803776     # 203.0.113.0
PEER_BASE = 167837696          # 10.1.0.0
KEY = b"view-key"
GRID = Grid(window_seconds=21600, stride_seconds=7200)
RULES = {
    "exfiltration_sent_bytes_gt": 3000, "exfiltration_distinct_dst_ips_lte": 3,
    "exfiltration_syn_lt": 10, "scan_distinct_dst_ports_gt": 9,
    "scan_sequential_port_ratio_gt": 0.1, "initial_access_syn_gt": 3, "impact_sent_pkts_gt": 5,
}
SETTINGS = Settings(grid=GRID, stage_rules=RULES, flow_timeout_seconds=43200)
OFFSET_HOURS = 4
SPLITS = ("train", "val", "test")
ATTACK_NAMES = ("FTP-BruteForce", "DoS-Hulk", "Infiltration", "Botnet-Ares", "Web-XSS", "DDoS-LOIC")


def logistic(z):
    return F.round(1 / (1 + F.exp(-z)), 6)


def score_a():
    return logistic(F.col("rst") * 0.9 + F.col("sent_pkts") * 0.1 - F.col("sent_bytes") * 0.0005 - 2.0)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        settings = hashlib.sha256(repr((SETTINGS, KEY, OFFSET_HOURS)).encode()).hexdigest()[:16]
        self.version = f"{self.sf_dir}/{input_fingerprint(spark, self.sf_dir)}/{settings}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _stage(self, name: str, build) -> DataFrame:
        return staged(self.spark, f"{self.version}/{name}", build)

    # -- packets and flows --------------------------------------------------
    def packets(self) -> DataFrame:
        e = self.table("events")
        host_no = F.col("user_id") % 15 + F.lit(15) * floor_div("user_id", 150)
        k = F.get_json_object("props", "$.k").cast("int")
        is_type = lambda *t: F.col("event_type").isin(*t).cast("int")
        size = F.floor(F.col("value") * 10).cast("long")
        eid = F.col("event_id")
        return e.select(
            eid.alias("packet_no"), epoch_us("ts").alias("ts_us"),
            F.when(host_no % 2 == 0, F.lit(INTERNAL_BASE) + host_no)
             .otherwise(F.lit(EXTERNAL_BASE) + host_no).cast("long").alias("src_ip"),
            (F.lit(PEER_BASE) + k % 5).cast("long").alias("dst_ip"),
            F.when(eid % 7 == 0, 443).otherwise(1024 + eid % 4).cast("int").alias("src_port"),
            k.alias("dst_port"),
            F.when(eid % 5 == 0, 17).otherwise(6).cast("int").alias("protocol"),
            (32 + eid % 33).cast("int").alias("ttl"), (8192 + eid % 4096).cast("int").alias("tcp_win"),
            (eid % 11 == 0).cast("int").alias("is_frag"), size.alias("payload_len"),
            F.lit(0).alias("is_retrans"),
            is_type("signup", "error").alias("syn"), is_type("click", "view").alias("ack"),
            is_type("purchase").alias("fin"), is_type("error").alias("rst"),
            is_type("view").alias("psh"), F.lit(0).alias("urg"), (eid % 3).alias("seq"))

    def marked_packets(self) -> DataFrame:
        """Packets folded to few sizes and ports, with retransmissions marked."""
        p = self.packets().withColumn("payload_len", F.col("payload_len") % 3).withColumn(
            "dst_port", F.col("dst_port") % 2)
        return PK.mark_retransmissions(p)

    def conversations(self) -> DataFrame:
        """Packets folded to a few sockets, every third one sent by the peer."""
        p = self.packets().withColumn("src_port", 40000 + F.col("src_port") % 2).withColumn(
            "dst_port", 80 + F.col("dst_port") % 3)
        back = F.col("packet_no") % 3 == 0
        swap = {"src_ip": "dst_ip", "dst_ip": "src_ip", "src_port": "dst_port", "dst_port": "src_port"}
        return p.select(*[F.when(back, F.col(swap[c])).otherwise(F.col(c)).alias(c) if c in swap else F.col(c)
                          for c in p.columns])

    def packet_flows(self) -> DataFrame:
        return self._stage("packet_flows", lambda: FL.assemble_flows(
            self.conversations(), SETTINGS.flow_timeout_seconds))

    def lineitem_flows(self) -> DataFrame:
        li = self.table("lineitem")
        key, no = F.col("l_orderkey"), F.col("l_linenumber")
        flag = lambda c: c.cast("int")
        return li.select(
            (epoch_us("l_shipdate") + key % 86400 * 1_000_000).alias("start_us"),
            (F.lit(INTERNAL_BASE) + F.col("l_suppkey")).cast("long").alias("src_ip"),
            (F.lit(PEER_BASE) + F.col("l_partkey") % 200).cast("long").alias("dst_ip"),
            F.when(no == 1, 443).when(no == 2, 22).otherwise(1024 + no).cast("int").alias("src_port"),
            (key % 1024).cast("int").alias("dst_port"),
            F.when(no == 3, 17).otherwise(6).cast("int").alias("protocol"),
            F.when(no == 7, 0.0).otherwise(F.col("l_quantity") * 600_000_000).alias("duration"),
            F.col("l_extendedprice").alias("fwd_bytes"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("bwd_bytes"),
            F.col("l_quantity").cast("long").alias("fwd_pkts"), no.cast("long").alias("bwd_pkts"),
            flag(F.col("l_returnflag") == "R").alias("syn"), flag(F.col("l_returnflag") == "A").alias("ack"),
            flag(F.col("l_returnflag") == "N").alias("fin"), flag(F.col("l_linestatus") == "O").alias("rst"),
            flag(F.col("l_linestatus") == "F").alias("psh"), F.lit(0).alias("urg"),
            F.when(F.col("l_returnflag") == "R", 8192 + no).otherwise(-1).alias("init_win_fwd"))

    def flow_networks(self) -> DataFrame:
        return self._stage("flow_networks", lambda: WN.network_buckets(self.lineitem_flows(), KEY))

    # -- timeline -----------------------------------------------------------
    def timeline(self) -> DataFrame:
        """Per (local day, external host) with resets: one attack with HH:MM local bounds."""
        return self._stage("timeline", self._timeline)

    def _timeline(self) -> DataFrame:
        local_s = floor_div("ts_us", 1_000_000) - OFFSET_HOURS * 3600
        day_no = floor_div(local_s, 86400)
        p = self.packets().filter(F.col("rst") == 1).filter(~is_internal("src_ip")).select(
            "src_ip", "dst_ip", local_s.alias("s"), day_no.alias("d"))
        g = p.groupBy("src_ip", "d").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"),
                                         F.max("s").alias("hi"), F.min("dst_ip").alias("victim"))
        idx = ((F.col("src_ip") + F.col("d")) % 6).cast("int")
        pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), idx + 1)
        hhmm = lambda c: F.concat_ws(
            ":", F.lpad((floor_div(c, 3600)).cast("string"), 2, "0"),
            F.lpad(floor_div(c % 3600, 60).cast("string"), 2, "0"))
        return g.select(
            F.date_format(F.date_from_unix_date(F.col("d").cast("int")), "yyyy-MM-dd").alias("date"),
            pick(ATTACK_NAMES).alias("name"), pick(STAGES[1:]).alias("stage"),
            hhmm(F.col("lo") - F.col("d") * 86400).alias("start"),
            hhmm(F.col("hi") - F.col("d") * 86400 + 60).alias("end"),      # the minute of the last reset counts whole
            F.array(ip_to_text("src_ip")).alias("attacker_ips"),
            F.array(ip_to_text("victim")).alias("victim_ips"))

    def intervals(self) -> DataFrame:
        return LB.attack_intervals(self.timeline(), OFFSET_HOURS)

    def split_map(self) -> DataFrame:
        """Every day from the first to the last of windows and timeline: 15 of 31 parts train, 7 validation, 9 test."""
        days = self.windows().select(floor_div("window_start", 86400).alias("d")).unionByName(
            self.timeline().select(F.unix_date(F.to_date("date")).cast("long").alias("d")))
        span = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo IS NOT NULL")
        part = (F.col("d") - F.col("lo") + 1) * 31
        whole = F.col("hi") - F.col("lo") + 1
        return span.select("lo", "hi", F.explode(F.sequence("lo", "hi")).alias("d")).select(
            F.date_format(F.date_from_unix_date(F.col("d").cast("int")), "yyyy-MM-dd").alias("day"),
            F.when(part <= 15 * whole, "train").when(part <= 22 * whole, "val").otherwise("test").alias("split"))

    def episodes(self) -> DataFrame:
        """Attacker episodes with a dense number in (start, host) order of the timeline."""
        ep = LB.attacker_episodes(self.timeline(), OFFSET_HOURS, self.split_map())
        # one number per (host, start): readable, unique, and no global sort
        return ep.withColumn("episode_no", F.col("start_s"))

    # -- windows ------------------------------------------------------------
    def windows(self) -> DataFrame:
        return self._stage("windows", lambda: WN.build_window_features(self.packets(), SETTINGS, KEY))

    def labelled(self) -> DataFrame:
        df = LB.label_windows(self.windows(), self.intervals(), GRID)
        return LB.assign_split(df, self.split_map())

    def scored(self) -> DataFrame:
        """Labelled windows with two fixed logistic scores, rounded to 6 places."""
        return self._stage("scored", self._scored)

    def _scored(self) -> DataFrame:
        c = F.col
        zb = c("distinct_dst_ports") * 0.3 + c("syn") * 0.25 - c("ttl_mean") * 0.05 - 0.5
        return self.labelled().select("*", (c("stage") != "benign").cast("int").alias("y"),
                                      score_a().alias("score_a"), logistic(zb).alias("score_b"))

    def scores_long(self) -> DataFrame:
        """(model, split, host, window_id, window_start, y, score): the score store's schema."""
        s = self.scored()
        keep = ["split", "host", "window_id", "window_start", "y"]
        return s.select(F.lit("a").alias("model"), *keep, F.col("score_a").alias("score")).unionByName(
            s.select(F.lit("b").alias("model"), *keep, F.col("score_b").alias("score")))

    def alerts(self) -> DataFrame:
        """Windows whose score_a reaches 0.4, as alert rows with stage and technique."""
        from ..operators.alerts import fire
        return fire(self.scored().drop("stage"), F.col("score_a") >= 0.4, "score_a", SETTINGS)



    # -- raw inputs derived from the tables ----------------------------------
    def frames(self) -> DataFrame:
        """Ethernet frames of the packets, with planned defects by frame number."""
        return self._stage("frames", self._frames)

    def _frames(self) -> DataFrame:
        p = self.packets()
        no = F.col("packet_no")
        hexn = lambda c, n: F.lpad(F.hex(c.cast("long")), n * 2, "0")
        tcp = F.col("protocol") == 6
        total = F.col("payload_len") + F.when(tcp, 40).otherwise(28)
        frag = F.when(no % 22 == 0, F.lit(0x2005)).when(no % 11 == 0, F.lit(0x2000)).otherwise(0)
        flags = (F.col("fin") + F.col("syn") * 2 + F.col("rst") * 4 + F.col("psh") * 8 + F.col("ack") * 16)
        kind = F.when(no % 13 == 0, F.lit("86DD")).when(no % 17 == 0, F.lit("0806")).otherwise(F.lit("0800"))
        vlan = F.when(no % 10 == 0, F.lit("81000001")).otherwise(F.lit(""))
        l4 = F.when(tcp, F.concat(
            hexn(F.col("src_port"), 2), hexn(F.col("dst_port"), 2), hexn(F.col("seq"), 4), F.lit("00000000"),
            F.lit("50"), hexn(flags, 1), hexn(F.col("tcp_win"), 2), F.lit("00000000"))).otherwise(F.concat(
                hexn(F.col("src_port"), 2), hexn(F.col("dst_port"), 2), F.lit("00000000")))
        text = F.concat(
            F.lit("00" * 12), vlan, kind, F.lit("4500"), hexn(total, 2), F.lit("0000"), hexn(frag, 2),
            hexn(F.col("ttl"), 1), hexn(F.col("protocol"), 1), F.lit("0000"), hexn(F.col("src_ip"), 4),
            hexn(F.col("dst_ip"), 4), l4)
        raw = F.unhex(text)
        raw = F.when(no % 19 == 0, F.substring(raw, 1, 30)).when(no % 40 == 0, F.substring(raw, 1, 36)).otherwise(raw)
        return p.select(no.alias("frame_no"), "ts_us", raw.alias("raw"))

    def flow_csv(self) -> str:
        """A defective flow CSV of the lineitem flows; returns its folder."""
        return staged_path(self.spark, f"{self.version}/flow_csv", self._write_flow_csv)

    def _write_flow_csv(self, path: str) -> None:
        from ..config import FLOW_COLUMNS
        fl = self.lineitem_flows()
        ts = F.date_format(F.timestamp_micros("start_us"), "dd/MM/yyyy hh:mm:ss a")
        text = lambda c: F.col(c).cast("string")
        cols = {
            "timestamp": ts, "src_ip": ip_to_text("src_ip"), "dst_ip": ip_to_text("dst_ip"),
            "iat_mean": F.when(F.col("dst_port") % 50 == 0, "Infinity").when(F.col("dst_port") % 50 == 1, "NaN")
            .otherwise(text("fwd_pkts")), "iat_std": F.lit("0"), "iat_max": F.lit("0"),
            "init_win_bwd": F.lit("-1"), "label": F.when(F.col("syn") == 1, "Attack ").otherwise(" Benign")}
        rows = fl.select(*[(cols[c] if c in cols else text(c)).alias(c) for c in FLOW_COLUMNS])
        echo = fl.filter((F.col("dst_port") == 7) & (F.col("bwd_pkts") == 1)).select(
            *[F.lit(raw).alias(c) for c, raw in FLOW_COLUMNS.items()])
        out = rows.unionByName(echo).toDF(*[f" {raw} " for raw in FLOW_COLUMNS.values()])
        out.write.mode("overwrite").option("header", "true").option("ignoreLeadingWhiteSpace", "false").option(
            "ignoreTrailingWhiteSpace", "false").csv(path)

    def operator_log(self) -> str:
        """Tab-separated stage logs per UTC date of the timeline's attacks; returns the folder.

        An attack that crosses midnight has one line in the log of each of its dates.
        """
        return staged_path(self.spark, f"{self.version}/operator_log", self._write_operator_log)

    def _write_operator_log(self, path: str) -> None:
        iv = self.intervals().withColumn("d", F.explode(F.sequence(floor_div("start_s", 86400), floor_div(F.col("end_s") - 1, 86400))))
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        hms = lambda s: F.concat_ws(":", two(floor_div(s, 3600)), two(floor_div(s % 3600, 60)), two(s % 60))
        midnight = F.col("d") * 86400
        begin = F.greatest(F.col("start_s") - midnight, F.lit(0).cast("long"))
        end = F.least(F.col("end_s") - midnight, F.lit(86400).cast("long"))
        line = F.concat_ws("\t", "stage", hms(begin), hms(end), F.col("hosts")[0], F.coalesce(F.get("hosts", F.lit(1)), F.lit("")))
        rows = iv.select(line.alias("value"), F.date_format(F.date_from_unix_date(F.col("d").cast("int")), "yyyy-MM-dd").alias("date"))
        days = rows.select("date").distinct()
        head = days.select(F.explode(F.array(F.lit("session_id\tx1"), F.lit("# columns: stage start end attacker victim"),
                                             F.lit(""), F.lit("benign\t00:00:00\t01:00:00\ta\tb"))).alias("value"), "date")
        rows.unionByName(head).write.mode("overwrite").partitionBy("date").text(path)

    # -- audit chain ------------------------------------------------------------
    LEDGER_FIELDS = ["host", "probability", "stage", "technique", "window_start"]
    LEDGER_BLOCK = 64

    def ledger(self) -> DataFrame:
        return self._stage("ledger", self._ledger)

    def _ledger(self) -> DataFrame:
        from ..operators.ledger import append_chain
        a = self.alerts().withColumn("probability", F.col("probability").cast("decimal(9,6)")).withColumn(
            "run", F.when(F.col("window_start") % 86400 < 43200, "am").otherwise("pm"))
        return append_chain(a, "run", ["window_start", "host"], self.LEDGER_FIELDS, KEY,
                            floor_div("window_start", 86400 * 7), block=self.LEDGER_BLOCK)
