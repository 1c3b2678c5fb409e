"""Registered queries: every operator bound to the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import alerts as AL
from ..operators import asof as AO
from ..operators import bootstrap as BS
from ..operators import flows as FL
from ..operators import forecast as FC
from ..operators import fusion as FU
from ..operators import labels as LB
from ..operators import ledger as LG
from ..operators import metrics as ME
from ..operators import models as ML
from ..operators import packets as PK
from ..operators import sequences as SQ
from ..operators import whatif as WI
from ..operators import windows as WN
from ..sources import flow_csv as CSV
from ..sources import frames as FR
from ..sources import operator_log as OL
from ..sources import stores as ST
from ..streaming import jobs as SJ
from .staging import table_path
from .views import EXTERNAL_BASE, GRID, KEY, RULES, SETTINGS, SPLITS, Views, score_a

REGISTRY: dict[str, Callable[[Views], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: round_doubles(fn(Views(spark, sf_dir)))
    return {name: bind(fn) for name, fn in REGISTRY.items()}


# -- packets and window features ----------------------------------------------

@query
def assign_windows(v):
    return PK.assign_windows(v.packets(), GRID).groupBy("window_id").agg(
        F.count(F.lit(1)).alias("n_packets"), F.count_distinct("src_ip").alias("n_hosts"),
        F.sum("payload_len").alias("bytes"))


@query
def packet_window_features(v):
    return PK.packet_window_features(v.packets(), GRID)


@query
def sent_window_features(v):
    return PK.sent_window_features(v.packets(), GRID)


@query
def window_features(v):
    return WN.build_window_features(v.packets(), SETTINGS, KEY)


@query
def label_windows(v):
    return v.labelled().select("host", "window_id", "stage", "split")


@query
def scored_windows(v):
    return v.scored().select("host", "window_id", "split", "stage", "y", "score_a", "score_b")


@query
def alerts(v):
    return v.alerts().drop("window_id")


# -- evaluation -----------------------------------------------------------------

BUDGETS = (0.01, 0.05)
MS = ["model", "split"]
RESAMPLES = 1000
HORIZON_STEPS = (0, 1, 4, 8)


def _results(v):
    return v._stage("results", lambda: ME.evaluate(v.scores_long(), v.episodes(), GRID, BUDGETS))


@query
def threshold_at_fpr(v):
    return ME.threshold_at_fpr(v.scores_long(), MS, BUDGETS).drop("n_false")


@query
def operating_points(v):
    return ME.operating_points(v.scores_long(), MS, BUDGETS)


@query
def classification_at_threshold(v):
    s = v.scores_long()
    fitted = ME.threshold_at_fpr(s.filter("split = 'val'"), ["model"], BUDGETS)
    return ME.classification(s, fitted, ["model"], MS, ["budget"])


@query
def auroc(v):
    return ME.auroc(v.scores_long(), MS)


@query
def calibration(v):
    return ME.reliability(v.scores_long(), MS)


@query
def calibration_error(v):
    return ME.calibration_error(v.scores_long(), MS)


@query
def lead_time(v):
    s = v.scores_long()
    runs = s.select("model", "split").distinct()
    return ME.lead_times(s.filter("score >= 0.5"), v.episodes(), runs, GRID, ["model"],
                         grace_seconds=GRID.stride_seconds).drop("name")


@query
def lead_time_summary(v):
    s = v.scores_long()
    runs = s.select("model", "split").distinct()
    return ME.lead_summary(ME.lead_times(s.filter("score >= 0.5"), v.episodes(), runs, GRID, ["model"]), ["model"])


@query
def alerts_per_host_day(v):
    s = v.scores_long().groupBy("model", "split").agg(
        F.count_if(F.col("score") >= 0.5).alias("n_alerts"), F.count(F.lit(1)).alias("n_windows"))
    return s.withColumn("rate", ME.alerts_per_host_day(F.col("n_alerts"), F.col("n_windows"), GRID))


@query
def evaluation_results(v):
    return ME.evaluate(v.scores_long(), v.episodes(), GRID, BUDGETS)


def _repeated(v):
    """Scores with the repeated (host, window) rows of overlapping captures."""
    s = v.scores_long().withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("window_id") % 3).cast("int"))))
    return s.withColumn("score", F.round(F.col("score") / (1 + F.col("copy")) + 1e-9, 6))


@query
def dedup_host_windows(v):
    return ME.dedup_host_windows(_repeated(v), MS, "max")


@query
def dedup_host_windows_mean(v):
    return ME.dedup_host_windows(_repeated(v), MS, "mean")


@query
def multiplicity_report(v):
    return ME.multiplicity_report(_repeated(v), MS)


@query
def random_baseline(v):
    s = v.scores_long()
    n = s.filter("score >= 0.5").groupBy(*MS).agg(F.count(F.lit(1)).alias("n_alerts"))
    fired = ME.random_baseline(s, n, MS)
    return ME.lead_summary(ME.lead_times(fired, v.episodes(), s.select(*MS).distinct(), GRID, ["model"]), ["model"])


@query
def label_agreement(v):
    return LB.label_agreement(v.scored(), (1, 4, 8))


@query
def shift_target(v):
    return LB.shift_target(v.scored(), 4).select("host", "window_id", "stage", "score_a")


@query
def spearman(v):
    return ME.spearman(v.scored(), ["split"], "score_a", "score_b")


@query
def per_episode_report(v):
    s = v.scores_long()
    fitted = ME.threshold_at_fpr(s.filter("split = 'val'"), ["model"], (0.05,))
    return ME.per_episode_report(s, v.episodes(), fitted, GRID)


@query
def threshold_transfer(v):
    return ME.threshold_transfer(v.scores_long(), v.episodes(), GRID, BUDGETS)


@query
def score_distribution(v):
    return ME.score_distribution(v.scores_long(), [*MS, "y"])


@query
def confusion_from_rates(v):
    return ME.confusion_from_rates(_results(v))


@query
def comparison_table(v):
    return ME.comparison_table(_results(v), 0.05, "test")


@query
def split_gap_table(v):
    return ME.split_gap_table(_results(v), 0.05)


@query
def select_by_validation(v):
    return ME.select_by_validation(_results(v), "a", 0.05)


@query
def episode_groups(v):
    return LB.episode_groups(v.scores_long().filter("model = 'a'"), v.episodes(), GRID, 2).select(
        "host", "window_id", "group_id")


def _grouped(v):
    return v._stage("grouped_scores", lambda: LB.episode_groups(v.scores_long(), v.episodes(), GRID))


@query
def bootstrap_auroc(v):
    return BS.auroc_interval(_grouped(v), MS, RESAMPLES).drop("unavailable")


@query
def bootstrap_f1(v):
    rows = _grouped(v).withColumn("threshold", F.lit(0.5))
    return BS.f1_interval(rows, MS, RESAMPLES).drop("unavailable")


@query
def bootstrap_mean_score(v):
    per = _grouped(v).groupBy(*MS, "group_id").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    stat = lambda w: F.sum(w * F.col("s")) / F.sum(w * F.col("n"))
    return BS.cluster_bootstrap(per, MS, stat, RESAMPLES).drop("unavailable")


@query
def annotate_intervals(v):
    fitted = ME.threshold_at_fpr(v.scores_long().filter("split = 'val'"), ["model"], BUDGETS)
    return BS.annotate_intervals(_grouped(v), fitted, RESAMPLES, cut=_cut(v))


@query
def bootstrap_callable(v):
    """A statistic given as a Python function of (y, score, weight): mean score of attacks less that of benign windows."""
    def gap(y, score, weight):
        attacks, others = weight * (y == 1), weight * (y == 0)
        if not attacks.sum() or not others.sum():
            return None
        return (attacks * score).sum() / attacks.sum() - (others * score).sum() / others.sum()

    return BS.callable_bootstrap(_grouped(v), MS, gap, RESAMPLES).drop("unavailable")


def _horizon_rows(v, k):
    """Both models' scores with the label k windows ahead, or the window's own for 0."""
    rows = LB.shift_target(v.scored(), k) if k else v.scored()
    rows = rows.withColumn("y", (F.col("stage") != "benign").cast("int"))
    keep = ["split", "host", "window_id", "y"]
    return rows.select(F.lit("a").alias("model"), *keep, F.col("score_a").alias("score")).unionByName(
        rows.select(F.lit("b").alias("model"), *keep, F.col("score_b").alias("score")))


@query
def annotate_horizon(v):
    """Intervals for every horizon, model and budget, clustered by the episode of the label; one horizon after the other."""
    out = []
    for k in HORIZON_STEPS:
        rows = v._stage(f"horizon_rows_{k}", lambda k=k: _horizon_rows(v, k))
        fitted = ME.threshold_at_fpr(rows.filter("split = 'val'"), ["model"], BUDGETS)
        out.append(_cut(v)(BS.annotate_horizon(rows, v.episodes(), fitted, GRID, k, RESAMPLES, cut=_cut(v))))
        # shuffle files of a horizon go when the driver collects the plan that made them
        v.spark._jvm.System.gc()
    return reduce(DataFrame.unionByName, out)


@query
def align_scores(v):
    s = v.scores_long()
    return FU.align_scores(s.filter("model = 'a'"), s.filter("model = 'b'"))


@query
def fuse_mean(v):
    return FU.fuse_mean(v.scored(), ["score_a", "score_b"]).select("host", "window_id", "score")


@query
def rank_fusion(v):
    return FU.rank_fusion(v.scored(), ["score_a", "score_b"]).select("split", "host", "window_id", "score")


@query
def causal_fusion(v):
    return FU.causal_fusion(v.scored(), ["score_a", "score_b"]).select("split", "host", "window_id", "score")


@query
def attack_intervals(v):
    return v.intervals().select("name", "stage", "start_s", "end_s", F.array_join("hosts", "|").alias("parties"))


@query
def attacker_episodes(v):
    return v.episodes().drop("episode_no")


@query
def attack_family(v):
    from ..functions.rules import attack_family as family
    return v.timeline().groupBy(family("name").alias("family")).agg(
        F.count(F.lit(1)).alias("n_attacks"), F.count_distinct("date").alias("n_days"))


@query
def drop_family(v):
    kept = LB.drop_family(v.scored(), v.timeline(), "bruteforce", check=False)
    return kept.groupBy("day", "stage").agg(F.count(F.lit(1)).alias("n"))


@query
def class_counts(v):
    return LB.class_counts(v.scored(), SPLITS)


@query
def union_splits(v):
    return WN.union_splits(v.windows(), v.split_map()).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("day").alias("n_days"),
        F.sum("sent_bytes").alias("sent_bytes"))


@query
def split_overlap(v):
    """Windows tagged by a split map that wrongly lists every validation day twice."""
    twice = v.split_map().unionByName(v.split_map().filter("split = 'val'").withColumn("split", F.lit("train")))
    return WN.split_overlap(v.windows().join(twice, "day"))


# -- packet statistics, flows ------------------------------------------------------

def _some_features(v, *names):
    return PK.packet_window_features(v.packets(), GRID).select("src_ip", "window_id", *names)


@query
def ttl_stats(v):
    return _some_features(v, "ttl_mean", "ttl_var")


@query
def tcp_win_stats(v):
    return _some_features(v, "tcp_win_mean", "tcp_win_var")


@query
def frag_and_retrans_counts(v):
    return PK.packet_window_features(v.marked_packets(), GRID).select(
        "src_ip", "window_id", "frag_flag_count", "retransmission_count")


@query
def payload_histogram(v):
    return _some_features(v, *[f"payload_hist_{i}" for i in range(8)])


@query
def port_spread(v):
    return PK.port_window_features(v.packets(), GRID)


@query
def sequential_port_ratio(v):
    return _some_features(v, "sequential_port_ratio")


@query
def mark_retransmissions(v):
    return v.marked_packets().groupBy("src_ip", "protocol").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_retrans").alias("n_retrans"),
        F.sum(F.when(F.col("is_retrans") == 1, F.col("packet_no")).otherwise(0)).alias("retrans_no_sum"))


@query
def merge_features(v):
    """Full outer join of features over disjoint packet subsets (TCP statistics, UDP sends)."""
    p = v.packets()
    return PK.merge_features(PK.packet_window_features(p.filter("protocol = 6"), GRID),
                             PK.sent_window_features(p.filter("protocol = 17"), GRID)).select(
        "src_ip", "window_id", "ttl_mean", "distinct_dst_ports", "sent_pkts", "distinct_dst_ips")


@query
def time_order(v):
    """Stable time order of each capture's packets as an explicit position."""
    from ..operators.ordered import row_numbers, with_quantile_chunk
    p = with_quantile_chunk(v.packets().select("src_ip", "ts_us", "packet_no"), "ts_us", "part")
    return row_numbers(p, [], F.col("part"), [F.col("ts_us"), F.col("packet_no")], "position").drop("part")


@query
def assemble_flows(v):
    return _in_seconds(FL.assemble_flows(v.conversations(), SETTINGS.flow_timeout_seconds))


def _in_seconds(flows):
    return flows.withColumns({c: F.col(c) / 1e6 for c in ("duration", "iat_mean", "iat_std", "iat_max")})


@query
def flows_to_windows(v):
    return FL.flows_to_windows(v.lineitem_flows(), GRID)


@query
def flows_to_windows_sentinel(v):
    return FL.flows_to_windows(v.lineitem_flows(), GRID, average_sentinel=True).select(
        "src_ip", "window_id", "syn_win_mean")


@query
def flow_window_features(v):
    """Flow input through the shared matrix: packet statistics 0, roles added."""
    flows = v.lineitem_flows()
    networks = v.flow_networks()
    return WN.mask_flow_only(WN.finish_features(FL.flows_to_windows(flows, GRID), SETTINGS, KEY, networks=networks)).select(
        "host", "window_id", "day", "ttl_mean", "port_entropy", "sent_bytes", "sent_pkts", "internal", "net24_bucket")


@query
def role_features(v):
    return FL.role_features(v.lineitem_flows(), KEY)


@query
def address_forms(v):
    """LONG address, dotted text and back, CIDR membership."""
    from ..functions import net
    p = v.packets().select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    return p.groupBy("ip").agg(F.count(F.lit(1)).alias("n")).select(
        "ip", "n", net.ip_to_text("ip").alias("text"), net.text_to_ip(net.ip_to_text("ip")).alias("back"),
        net.is_internal("ip").cast("int").alias("internal"))


@query
def pseudonymise(v):
    from ..functions import crypto
    hosts = v.windows().join(v.split_map(), "day").select("host", "split").distinct()
    return hosts.select("host", "split", crypto.pseudonym("host", KEY).alias("pseudonym"),
                        crypto.pseudonym("host", KEY, heldout=True, split=F.col("split")).alias("heldout_pseudonym"),
                        crypto.net24_bucket("host", KEY).alias("net24_bucket"))


# -- alerts -----------------------------------------------------------------------

@query
def infer_stage(v):
    from ..functions.rules import infer_stage as rule
    return v.scored().groupBy("split", rule(RULES).alias("rule_stage")).agg(F.count(F.lit(1)).alias("n"))


@query
def map_technique(v):
    """Techniques of the timeline stages (a different path from the inferred stages)."""
    from ..functions.rules import map_technique as rule
    s = v.scored().withColumn("t", rule("stage", RULES, SETTINGS.techniques, set(SETTINGS.feature_columns())))
    return s.groupBy("stage", F.col("t.technique").alias("technique"), F.col("t.name").alias("technique_name")).agg(
        F.count(F.lit(1)).alias("n"))


@query
def apply_thresholds(v):
    s = v.scores_long()
    t = ME.threshold_at_fpr(s.filter("split = 'val'"), ["model"], (0.05,))
    return AL.apply_thresholds(s, t, ["model"]).groupBy("model", "split", "host").agg(
        F.count_if("alert").alias("n_alerts"), F.count(F.lit(1)).alias("n_windows"))


@query
def exclude_host(v):
    flows, wf = AL.exclude_host(v.packet_flows(), v.scored(), 3405803777, "203.0.113.1")
    one = F.count(F.lit(1))
    return flows.groupBy(F.lit("flows").alias("what"), F.col("dst_port").cast("string").alias("item")).agg(
        one.alias("n")).unionByName(wf.groupBy(F.lit("windows").alias("what"), F.col("host").alias("item")).agg(
            one.alias("n")))


@query
def exclusion_report(v):
    return AL.exclusion_report(v.packet_flows(), v.alerts())


@query
def check_contract(v):
    return AL.contract_violations(v.alerts().withColumn(
        "probability", F.when(F.col("window_id") % 11 == 0, 1.5).otherwise(F.col("probability"))).withColumn(
        "stage", F.when(F.col("window_id") % 13 == 0, "odd").otherwise(F.col("stage"))))


@query
def hosts_pseudonymised(v):
    from ..functions.crypto import pseudonym
    plain = AL.hosts_pseudonymised(v.alerts().select("host")).withColumn("which", F.lit("plain"))
    keyed = AL.hosts_pseudonymised(v.alerts().select(pseudonym("host", KEY).alias("host"))).withColumn(
        "which", F.lit("keyed"))
    none = AL.hosts_pseudonymised(v.alerts().filter("probability > 2").select("host")).withColumn(
        "which", F.lit("empty"))
    return plain.unionByName(keyed).unionByName(none).withColumn("pseudonymised", F.col("pseudonymised").cast("int"))


@query
def flagged_flows(v):
    return AL.flagged_flows(v.alerts(), v.packet_flows(), GRID).drop("window_id")


@query
def top_contributing_windows(v):
    return AL.top_contributing_windows(v.scored(), v.alerts(), GRID, "score_a", 12 * GRID.stride_seconds)


@query
def host_graph_nodes(v):
    return AL.host_graph(v.packet_flows(), v.alerts(), v.windows())[0]


@query
def host_graph_edges(v):
    return AL.host_graph(v.packet_flows(), v.alerts(), v.windows())[1]


@query
def graph_top_nodes(v):
    nodes, edges = AL.host_graph(v.packet_flows(), v.alerts(), v.windows())
    return AL.graph_top_nodes(nodes, edges, 18)[0].withColumn("truncated", F.col("truncated").cast("int"))


@query
def graph_top_edges(v):
    nodes, edges = AL.host_graph(v.packet_flows(), v.alerts(), v.windows())
    return AL.graph_top_nodes(nodes, edges, 18)[1]


@query
def network_timeline(v):
    return AL.network_timeline(v.alerts())


@query
def host_ranking(v):
    return AL.host_ranking(v.alerts())


@query
def top_alert_per_host(v):
    return AL.top_alert_per_host(v.alerts()).select("host", "probability", "window_start", "stage", "technique")


@query
def run_summary(v):
    return AL.run_summary(v.packet_flows(), v.windows(), v.alerts(), None, 0.4, keyed=True)


# -- sequences and forecasts --------------------------------------------------------

SEQ_FEATURES = ["sent_pkts", "syn"]
SEGMENT = 16


@query
def gap_features(v):
    return SQ.gap_features(v.scored(), clamp=12).select(
        "host", "window_id", "gap", F.col("has_previous").cast("int").alias("has_previous"))


@query
def gap_stats(v):
    return SQ.gap_stats(v.scored(), ["split"])


def _segments(v):
    return SQ.segment(v.scored(), SEQ_FEATURES, SEGMENT)


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|", "-")


@query
def segment(v):
    return _segments(v).select(
        "host", "segment_no", "n_real", _text("window_ids").alias("ids"), _text("y").alias("ys"),
        F.size(F.filter("pad_mask", lambda m: m)).alias("n_pad"),
        F.aggregate("x", F.lit(0.0), lambda a, x: a + x[0] + x[1] * 2).alias("x_sum"))


@query
def segment_scatter_back(v):
    s = _segments(v).withColumn("v", F.transform("x", lambda x: x[0] + x[1] / 4))
    return SQ.scatter_back(s, "v")


@query
def padding_stats(v):
    return SQ.padding_stats(_segments(v), SEGMENT)


@query
def host_sequences(v):
    return SQ.host_sequences(v.scored(), SEQ_FEATURES, 48).select(
        "host", _text("window_ids").alias("ids"), F.size(F.filter("pad_mask", lambda m: m)).alias("n_pad"),
        F.aggregate("x", F.lit(0.0), lambda a, x: a + x[0] + x[1] * 2).alias("x_sum"))


@query
def source_windows(v):
    return FC.source_windows(v.scored()).select("host", "window_id", "recency")


def _forecast(v):
    heads = {k: (F.round(F.col("score_a") * (1 - 0.05 * k) + 1e-9, 6), t) for k, t in ((1, .3), (4, .25), (8, .2))}
    return FC.kstep_forecast(FC.source_windows(v.scored().drop("stage")), heads, SETTINGS)


@query
def kstep_forecast(v):
    return _forecast(v).withColumn("alert", F.col("alert").cast("int"))


@query
def per_host_curve(v):
    return FC.per_host_curve(_forecast(v)).select("host", F.inline("points")).withColumn(
        "alert", F.col("alert").cast("int"))


@query
def kstep_detail(v):
    fc = _forecast(v)
    return FC.kstep_detail(FC.per_host_curve(fc), fc, GRID.stride_seconds).withColumn(
        "alert", F.col("alert").cast("int"))


@query
def kstep_hosts(v):
    return FC.kstep_hosts(_forecast(v))


@query
def horizon_table(v):
    return FC.horizon_table(v.scored(), v.episodes(), GRID, 0.05, score="score_a")


@query
def epoch_node_ids(v):
    return SQ.epoch_node_ids(v.windows(), KEY, epoch=3)


@query
def host_state_asof(v):
    return AO.host_state_asof(v.windows(), v.packet_flows(), GRID)


@query
def neighbour_agg(v):
    return AO.neighbour_agg(v.windows(), v.packet_flows(), GRID)


# -- sources and stores ---------------------------------------------------------------

@query
def decode_frames(v):
    return FR.decode_frames(v.frames())


@query
def frame_coverage(v):
    return FR.frame_coverage(v.frames())


@query
def read_flow_csv(v):
    raw = CSV.read_flow_csv(v.spark, v.flow_csv())
    one = F.count(F.lit(1))
    return raw.groupBy("Label").agg(
        one.alias("n"), (F.sum("TotLen Fwd Pkts") / 1e6).alias("fwd_megabytes"), F.count("Flow IAT Mean").alias("n_iat"),
        F.sum("Flow IAT Mean").alias("iat_sum"), F.sum("Dst Port").cast("long").alias("port_sum"))


@query
def to_canonical(v):
    flows = CSV.to_canonical(CSV.read_flow_csv(v.spark, v.flow_csv()))
    return flows.groupBy(F.date_format("timestamp", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("start_us") / 1e6).cast("long").alias("start_sum"),
        F.count_distinct("src_ip").alias("n_src"), F.sum("fwd_pkts").cast("long").alias("fwd_pkts"))


@query
def read_operator_log(v):
    log = OL.read_operator_log(v.spark, v.operator_log())
    return log.select("date", "stage", "start_s", "end_s", F.array_join("hosts", "|").alias("parties"))


@query
def sample_hosts(v):
    hosts = v.windows().select("day", "host")
    return OL.sample_hosts(hosts, _timeline_hosts(v), 3)


def _timeline_hosts(v):
    parties = F.explode(F.array_union("attacker_ips", "victim_ips")).alias("host")
    return v.timeline().select(F.col("date").alias("day"), parties)


@query
def missing_victims(v):
    victims = v.timeline().select(F.col("date").alias("day"), F.explode("victim_ips").alias("host"))
    return OL.missing_victims(v.windows().select("day", "host"), victims)


@query
def feature_store(v):
    """Write features per day and capture, read every day back."""
    path = table_path(v.spark, f"{v.version}/feature_store")
    ST.write_features(v.windows().withColumn("capture_id", F.col("internal")), path)
    return ST.read_features(v.spark, path).groupBy("day", "capture_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sent_bytes").alias("sent_bytes"))


@query
def missing_captures(v):
    """A resumed run: captures of the last day have no features yet."""
    path = table_path(v.spark, f"{v.version}/resumed_store")
    wins = v.windows().withColumn("capture_id", F.col("internal"))
    last = wins.agg(F.max("day")).scalar()
    ST.write_features(wins.filter(F.col("day") < last), path)
    return ST.missing_captures(wins.select("day", "capture_id").distinct(), v.spark, path).select(
        "day", F.col("capture_id").cast("int").alias("capture_id"))


@query
def score_store(v):
    path = table_path(v.spark, f"{v.version}/score_store")
    ST.write_scores(v.scores_long(), path)
    return ST.read_scores(v.spark, path).groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("score_sum"))


@query
def write_alerts(v):
    """Alert objects and run summary as JSON, read back."""
    path = table_path(v.spark, f"{v.version}/alert_files")
    objects = _alert_objects(v)
    ST.write_alerts(objects, AL.run_summary(v.packet_flows(), v.windows(), v.alerts(), None, 0.4, True), path)
    back = v.spark.read.json(f"{path}/alerts")
    facts = v.spark.read.json(f"{path}/run_summary").select("n_alerts").scalar()
    return back.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("top_windows")).alias("n_windows"),
        F.sum(F.size("flagged_flows")).alias("n_flows"), F.max("probability").alias("peak")).withColumn(
        "n_alerts", facts)


def _alert_objects(v):
    wins = AL.top_contributing_windows(v.scored(), v.alerts(), GRID, "score_a", 12 * GRID.stride_seconds)
    return AL.alert_objects(v.alerts(), _linear_explanations(v), wins, AL.flagged_flows(v.alerts(), v.packet_flows(), GRID))


@query
def alert_objects(v):
    return _alert_objects(v).select(
        "host", "window_start", F.size("top_features").alias("n_features"), F.size("top_windows").alias("n_windows"),
        F.size("flagged_flows").alias("n_flows"), F.element_at("top_features.feature", 1).alias("first_feature"))


@query
def read_results(v):
    """Result files per model (one an experiment, one repeated), read back as shipped rows."""
    path = table_path(v.spark, f"{v.version}/results_json")
    r = _results(v).filter("budget = 0.05 and split = 'test'")
    block = F.struct("auroc", "f1", "recall").alias("test")
    rows = r.select("model", F.lit(None).cast("string").alias("holdout_family"), block)
    tagged = r.select(F.concat("model", F.lit("__exp")).alias("model"), F.lit(None).cast("string").alias("holdout_family"), block)
    rows.unionByName(rows).unionByName(tagged).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return ST.read_results(v.spark, path, multi_line=False).select("model", "test.auroc", "test.f1", "test.recall")


# -- what-if transforms ------------------------------------------------------------------

def _attackers(v):
    """Addresses of all attackers of the timeline."""
    from ..functions import net
    return v.timeline().select(F.explode("attacker_ips").alias("ip")).select(net.text_to_ip("ip").alias("src_ip")).distinct()


@query
def permute_ports(v):
    """Port counts per socket are preserved; only their order changes."""
    p = WI.permute_ports(v.packets(), _attackers(v))
    return p.groupBy("src_ip", "dst_ip", "src_port", "dst_port").agg(F.count(F.lit(1)).alias("n"))


@query
def permuted_port_order(v):
    return WI.permute_ports(v.packets(), _attackers(v)).select("packet_no", "dst_port")


@query
def pace(v):
    return WI.pace(v.packets(), _attackers(v), 5.0).select("packet_no", "ts_us")


@query
def rechunk_payload(v):
    return WI.rechunk_payload(v.packets(), _attackers(v), 3).groupBy("src_ip", "payload_len").agg(
        F.count(F.lit(1)).alias("n"))


@query
def randomise_header(v):
    p = WI.randomise_header(v.packets(), _attackers(v), "ttl", 32, 65)
    return WI.randomise_header(p, _attackers(v), "tcp_win", 8192, 65536).select("packet_no", "ttl", "tcp_win")


@query
def evasion_table(v):
    return WI.evasion_table(v.packets(), _attackers(v), SETTINGS,
                            cut=lambda df: v._stage(f"variants/{uuid.uuid4().hex}", lambda: df))


# -- audit ledger ---------------------------------------------------------------------------

def _tampered(v):
    return v.ledger().withColumn("stage", F.when(F.col("seq") == 70, "edited").otherwise(F.col("stage")))


@query
def append_chain(v):
    return v._ledger().withColumn("probability", F.col("probability").cast("double"))


@query
def verify_chain(v):
    return LG.verify_chain(v.ledger(), v.LEDGER_FIELDS, v.LEDGER_BLOCK)


@query
def verify_tampered_chain(v):
    return LG.verify_chain(_tampered(v), v.LEDGER_FIELDS, v.LEDGER_BLOCK)


@query
def verify_spliced_chain(v):
    """Copies of the chains with a block removed, the front removed, and two blocks exchanged; heads kept beside them."""
    chain, size = v.ledger(), v.LEDGER_BLOCK
    levels = v._stage("ledger_heads", lambda: LG.head_levels(v.ledger(), KEY, size))
    other = F.when(F.col("block_no") == 0, 1).when(F.col("block_no") == 1, 0).otherwise(F.col("block_no"))
    moved = (other - F.col("block_no")) * size
    copies = {"removed": chain.filter("block_no <> 1"), "front": chain.filter("block_no <> 0"),
              "exchanged": chain.withColumn("seq", F.col("seq") + moved).withColumn("block_no", other.cast("long"))}
    out = None
    for name, copy in copies.items():
        part = LG.verify_chain(copy, v.LEDGER_FIELDS, size, levels).withColumn("copy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def merkle_root(v):
    leaves = v.ledger().select("chain", F.col("seq").alias("idx"), LG.leaf_hash(F.col("hash")).alias("leaf"))
    return LG.merkle_root(leaves)


@query
def checkpoint(v):
    return LG.checkpoint(v.ledger(), v.LEDGER_FIELDS, KEY)


@query
def ledger_status(v):
    """Status of the intact, an edited and a truncated copy of the chains."""
    log = LG.checkpoint(v.ledger(), v.LEDGER_FIELDS, KEY)
    copies = {"intact": v.ledger(), "edited": _tampered(v), "truncated": v.ledger().filter("seq < 60")}
    out = None
    for name, chain in copies.items():
        part = LG.ledger_status(chain, log, v.LEDGER_FIELDS, KEY, v.LEDGER_BLOCK).withColumn("copy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# -- model jobs -----------------------------------------------------------------------------

ML_FEATURES = ["sent_pkts", "sent_bytes", "syn", "rst", "distinct_dst_ports", "port_entropy", "ttl_mean"]
HEAD = {"sent_pkts": 0.8, "sent_bytes": -0.3, "syn": 0.5, "rst": 1.1, "port_entropy": -0.2, "ttl_mean": 0.4}
VIEW_TREES = 8


def _cut(v):
    """Rows that a model job goes over many times, written once and read back."""
    return lambda df: v._stage(f"model_rows/{uuid.uuid4().hex}", lambda: df)


def _labelled(v):
    return v.scored().drop("y", "score_a", "score_b")


@query
def fit_scaler(v):
    return ML.scaler_table(v.scored().filter("split = 'train'"), SETTINGS.feature_columns())


@query
def assemble_split(v):
    rows, scaler = ML.assemble_split(_labelled(v), "train", ML_FEATURES, 4)
    val, _ = ML.assemble_split(_labelled(v), "val", ML_FEATURES, 4, scaler)
    return rows.unionByName(val).groupBy("split", "y").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in ML_FEATURES])


@query
def class_weights(v):
    return ML.class_weights(v.scored(), ["split"])


def _linear_explanations(v):
    scaler = ML.fit_scaler(v.scored().filter("split = 'train'"), list(HEAD))
    return ML.explain_linear(v.scored().filter("score_a >= 0.4"), HEAD, scaler, 3)


@query
def explain_top_features(v):
    return _linear_explanations(v)


@query
def explain_occlusion(v):
    train, scaler = ML.assemble_split(_labelled(v), "train", ML_FEATURES)
    model = ML.fit_boosted_trees(train, ML_FEATURES, trees=VIEW_TREES)
    fired = ML.apply_scaler(v.scored().filter("score_a >= 0.4"), scaler)
    return ML.explain_occlusion(model, fired, ML_FEATURES, 3)


@query
def fit_logistic(v):
    return ME.auroc(ML.train_and_score(_labelled(v), ML_FEATURES), MS)


@query
def fit_boosted_trees(v):
    return ME.auroc(ML.train_and_score(_labelled(v), ML_FEATURES, "trees", trees=VIEW_TREES), MS)


@query
def fit_horizon_heads(v):
    """Heads of every horizon and both variants, written to the versioned store and read back from it."""
    path = table_path(v.spark, f"{v.version}/heads/{uuid.uuid4().hex}")
    ST.write_heads(*ML.fit_horizon_heads(_labelled(v), ML_FEATURES, GRID, HORIZON_STEPS, BUDGETS, "trees", _cut(v), trees=2, depth=3), path)
    return ST.read_thresholds(v.spark, path)


@query
def head_on_snapshot(v):
    """Linear head on as-of host states, benign rows sampled to 800."""
    state = AO.host_state_asof(v.windows(), v.packet_flows(), GRID)
    rows = _cut(v)(state.join(v.scored().select("host", "window_id", "split", "y"), ["host", "window_id"]).withColumnRenamed(
        "syn", "state_syn"))
    cols = ["bytes", "pkts", "duration_s", "state_syn"]
    scaler = ML.fit_scaler(rows.filter("split = 'train'"), cols)
    scaled = ML.apply_scaler(rows, scaler)
    model = ML.head_on_snapshot(scaled.filter("split = 'train'"), cols, 800)
    scored = ML.score(model, scaled.filter("split <> 'train'"), cols)
    return ME.auroc(scored, ["split"])


@query
def isotonic_calibrate(v):
    out = ML.isotonic_calibrate(v.scored().withColumnRenamed("score_a", "score"))
    return ME.calibration_error(out.withColumn("score", F.col("probability")), ["split"])


@query
def fuse_stack(v):
    return ME.auroc(ML.fuse_stack(v.scored(), ["score_a", "score_b"]), ["split"])


@query
def feature_ablation(v):
    return ML.feature_ablation(_labelled(v), ML_FEATURES, ["rst"], v.episodes(), GRID, "logistic", (0.05,))


@query
def split_comparison(v):
    return ML.inflation(ML.split_comparison(_labelled(v), ML_FEATURES, 2, cut=_cut(v)))


@query
def holdout_family(v):
    return ME.auroc(ML.train_and_score(_labelled(v), ML_FEATURES, timeline=v.timeline(), holdout="bruteforce",
                                       name="logistic_holdout"), MS)


# -- streams --------------------------------------------------------------------------------

def _stream_packets(v):
    """The packet view over a file stream of the events table."""
    live = Views(v.spark, v.sf_dir)
    schema = v.table("events").schema
    live.table = lambda name: v.spark.readStream.schema(schema).parquet(f"{v.sf_dir}/{name}.parque[t]")
    return live.packets()


def _run_closed(v, name, make, packets, span_us):
    """The stream with its tail; rows dropped as late stand beside every row."""
    path = table_path(v.spark, f"{v.version}/stream/{name}/{uuid.uuid4().hex}")
    dropped = SJ.write_closed_stream(make, packets, path, 3_600_000_000, span_us)
    return v.spark.read.parquet(f"{path}/out").withColumn("n_dropped_late", F.lit(dropped).cast("long"))


def _window_stream(v, name):
    return _run_closed(v, name, lambda p: SJ.packet_window_stream(p, GRID, "1 hour"), _stream_packets(v), GRID.window_us)


def _port_stream(v, name):
    return _run_closed(v, name, lambda p: SJ.port_window_stream(p, GRID, "1 hour"), _stream_packets(v), GRID.window_us)


def _flow_stream(v, name):
    live = Views(v.spark, v.sf_dir)
    packets = _stream_packets(v)
    live.packets = lambda: packets
    return _in_seconds(_run_closed(v, name, lambda p: SJ.assemble_flows_stream(p, "1 hour", SETTINGS.flow_timeout_seconds),
                                   live.conversations(), SETTINGS.flow_timeout_seconds * 2_000_000))


@query
def window_features_stream(v):
    return _window_stream(v, "packets").drop("n_dropped_late")


@query
def port_spread_stream(v):
    return _port_stream(v, "ports").drop("n_dropped_late")


@query
def assemble_flows_stream(v):
    return _flow_stream(v, "flows").drop("n_dropped_late")


@query
def window_features_stream_closed(v):
    return _window_stream(v, "packets_closed")


@query
def port_spread_stream_closed(v):
    return _port_stream(v, "ports_closed")


@query
def assemble_flows_stream_closed(v):
    return _flow_stream(v, "flows_closed")


@query
def alerts_stream(v):
    """Windows of the stream scored, fired with stage and technique and chained per micro-batch, end row included."""
    from ..operators.alerts import fire
    path = table_path(v.spark, f"{v.version}/stream/alerts/{uuid.uuid4().hex}")

    def fired(batch):
        rows = WN.finish_features(batch, SETTINGS, KEY).withColumn("score_a", score_a())
        return fire(rows, F.col("score_a") >= 0.4, "score_a", SETTINGS).withColumn(
            "probability", F.col("probability").cast("decimal(9,6)")).withColumn("run", F.lit("run"))

    SJ.write_closed_stream(
        lambda p: SJ.packet_window_stream(p, GRID, "1 hour"), _stream_packets(v), path, 3_600_000_000, GRID.window_us,
        lambda wins: SJ.alerts_stream(wins, fired, f"{path}/chain", f"{path}/checkpoint", KEY, "run", ["window_start", "host"],
                                      v.LEDGER_FIELDS, SETTINGS, v.LEDGER_BLOCK))
    chain = v.spark.read.parquet(f"{path}/chain")
    kinds = chain.groupBy("chain", "stage", "technique").agg(
        F.count(F.lit(1)).alias("n_alerts"), F.sum("probability").cast("double").alias("probability"),
        F.min("window_start").alias("first_start"), F.max("window_start").alias("last_start"))
    return kinds.join(LG.verify_chain(chain, v.LEDGER_FIELDS, v.LEDGER_BLOCK), "chain")
