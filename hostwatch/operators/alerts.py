"""Alerts: firing, context, host graph and triage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, STAGES, UNCLASSIFIED, Grid, Settings
from ..functions.columns import floor_div, require_columns
from ..functions.net import ip_to_text, looks_like_ip
from ..functions.rules import infer_stage, map_technique
from .ordered import per_key

ALERT_FIELDS = ("host", "window_start", "probability", "stage", "technique", "technique_name")


def fire(scored: DataFrame, condition: Column, score: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Alert rows of the windows that meet the condition, with stage and technique."""
    features = set(settings.feature_columns()) & set(scored.columns)
    hits = scored.filter(condition).withColumn("stage", infer_stage(settings.stage_rules))
    tech = map_technique("stage", settings.stage_rules, settings.techniques, features)
    return hits.withColumn("_t", tech).select(
        "host", "window_id", "window_start", F.col(score).alias("probability"), "stage",
        F.col("_t.technique").alias("technique"), F.col("_t.name").alias("technique_name"))


def apply_thresholds(scores: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Flag scores at or above their key's threshold; a key without one fails the query."""
    joined = scores.join(per_key(thresholds.select(*keys, "threshold")), keys, "left")
    known = F.when(F.col("threshold").isNotNull(), F.col("threshold")).otherwise(
        F.raise_error(F.concat(F.lit("no threshold for "), F.concat_ws("/", *keys))).cast("double"))
    return joined.withColumn("threshold", known).withColumn("alert", F.col("score") >= F.col("threshold"))


def exclude_host(flows: DataFrame, wf: DataFrame, host_ip: int, host: str) -> tuple[DataFrame, DataFrame]:
    """What-if: drop a host's windows and every flow it takes part in; nothing is recomputed."""
    kept = flows.filter((F.col("src_ip") != host_ip) & (F.col("dst_ip") != host_ip))
    return kept, wf.filter(F.col("host") != host)


def exclusion_report(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """For every host: alerts and flows left when that host is removed, and the change.

    One pass: per-host counts against the totals instead of one re-run per host.
    """
    sides = flows.select(F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("ip"))
    touched = sides.groupBy("ip").agg(F.count(F.lit(1)).alias("flows_removed")).select(
        ip_to_text("ip").alias("host"), "flows_removed")
    own = alerts.groupBy("host").agg(F.count(F.lit(1)).alias("alerts_removed"))
    out = touched.join(own, "host", "full_outer").fillna(0)
    n_flows = flows.agg(F.count(F.lit(1))).scalar()
    n_alerts = alerts.agg(F.count(F.lit(1))).scalar()
    return out.select(
        "host", n_alerts.alias("alerts_before"),
        (n_alerts - F.col("alerts_removed")).alias("alerts_after"),
        (-F.col("alerts_removed")).alias("alert_delta"),
        n_flows.alias("flows_before"), (n_flows - F.col("flows_removed")).alias("flows_after"))


def contract_violations(alerts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row of violation counts: missing values, score range, stage names."""
    require_columns(alerts, ALERT_FIELDS, "alert table")
    stages = [*STAGES, UNCLASSIFIED]
    p = F.col("probability")
    return alerts.agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.count_if(F.col("host").isNull() | F.col("window_start").isNull()).alias("missing_key"),
        F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).alias("bad_probability"),
        F.count_if(F.col("stage").isNull() | ~F.col("stage").isin(stages)).alias("bad_stage"))


def schema_drift(df: DataFrame, expected) -> tuple[list[str], list[str]]:
    """(missing, unexpected) column names against the expected list."""
    have, want = set(df.columns), set(expected)
    return sorted(want - have), sorted(have - want)


def check_contract(df: DataFrame, expected) -> DataFrame:
    """Return the frame unchanged, or raise naming the columns that drifted."""
    missing, extra = schema_drift(df, expected)
    if missing or extra:
        raise ValueError(f"columns drifted: missing {missing}, unexpected {extra}")
    return df


def hosts_pseudonymised(hosts: DataFrame) -> DataFrame:
    """One row: true only if there are hosts and none is a literal address."""
    return hosts.agg(
        F.count(F.lit(1)).alias("n_hosts"),
        F.coalesce(F.bool_and(~looks_like_ip("host")), F.lit(False)).alias("pseudonymised"))


def flagged_flows(alerts: DataFrame, flows: DataFrame, grid: Grid, top: int = 5) -> DataFrame:
    """Per alert the largest flows the host started inside the window.

    Flows are keyed to the windows that cover their start; those of windows without an
    alert go before the others are cut to the top k per (host, window).
    """
    last = floor_div("start_us", grid.stride_us)
    fl = flows.select(
        ip_to_text("src_ip").alias("host"), "dst_port", "protocol",
        (F.col("fwd_bytes") + F.col("bwd_bytes")).alias("bytes"), "syn",
        F.col("duration").alias("duration_us"), "start_us",
        F.explode(F.sequence(last - (grid.n_bins - 1), last)).alias("window_id"))
    keys = alerts.select("host", "window_id", "window_start")
    fl = fl.join(keys.select("host", "window_id").distinct(), ["host", "window_id"], "left_semi")
    order = [F.col("bytes").desc(), "start_us", "dst_port", "protocol", "syn", "duration_us"]
    ranked = fl.withColumn("rank", F.row_number().over(
        Window.partitionBy("host", "window_id").orderBy(*order))).filter(F.col("rank") <= top)
    return keys.join(ranked, ["host", "window_id"]).drop("start_us")


def top_contributing_windows(scored: DataFrame, alerts: DataFrame, grid: Grid, score: str,
                             context_seconds: int, k: int = 3) -> DataFrame:
    """Per alert the k highest-scoring windows of the host in the context up to it.

    Alerts fan out to the (bounded) ids of their context, an equi join; ties go to
    the most recent window.
    """
    reach = context_seconds // grid.stride_seconds
    want = alerts.select("host", "window_start", F.col("window_id").alias("alert_id"), F.explode(
        F.sequence(F.col("window_id") - reach, F.col("window_id"))).alias("window_id"))
    hist = scored.select("host", "window_id", F.col(score).alias("probability"))
    w = Window.partitionBy("host", "alert_id").orderBy(F.col("probability").desc(), F.col("window_id").desc())
    out = want.join(hist, ["host", "window_id"]).withColumn("rank", F.row_number().over(w)).filter(
        F.col("rank") <= k)
    return out.select(
        "host", "window_start", "rank", (F.col("window_id") * grid.stride_seconds).alias("context_start"),
        "probability", ((F.col("alert_id") - F.col("window_id")) * grid.stride_seconds).alias("seconds_before_alert"))


def alert_objects(alerts: DataFrame, top_features: DataFrame, top_windows: DataFrame,
                  flows: DataFrame) -> DataFrame:
    """Nested alert rows: each list is bounded by its k, so collecting it is safe."""
    key = ["host", "window_start"]

    def nest(df, name, fields):
        item = F.struct("rank", *fields)
        lists = df.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias(name))
        return lists

    out = alerts
    for df, name, fields in (
        (top_features, "top_features", ["feature", "value", "contribution"]),
        (top_windows, "top_windows", ["context_start", "probability", "seconds_before_alert"]),
        (flows, "flagged_flows", ["dst_port", "protocol", "bytes", "syn", "duration_us"]),
    ):
        out = out.join(nest(df, name, fields), key, "left")
        empty = F.array().cast(out.schema[name].dataType)
        out = out.withColumn(name, F.coalesce(name, empty))
    return out.withColumn("estimated_lead_seconds", F.lit(None).cast("double"))


def host_graph(flows: DataFrame, alerts: DataFrame, wf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): flow counts per directed pair, peak score and alert count per host."""
    peak = alerts.groupBy("host").agg(F.max("probability").alias("peak_prob"),
                                      F.count(F.lit(1)).alias("n_alerts"))
    pairs = flows.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("weight")).select(
        ip_to_text("src_ip").alias("src"), ip_to_text("dst_ip").alias("dst"), "weight")
    risk = peak.select(F.col("host").alias("src"), F.col("peak_prob").alias("risk"))
    edges = pairs.join(risk, "src", "left").fillna(0.0, subset=["risk"]).select("src", "dst", "weight", "risk")
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("host")).unionByName(peak.select("host")).distinct()
    inside = wf.groupBy("host").agg(F.max("internal").alias("internal"))
    nodes = (ends.join(peak, "host", "left").join(inside, "host", "left")
             .fillna(0.0, subset=["peak_prob"]).fillna(0, subset=["n_alerts"]))
    return nodes.select("host", "peak_prob", "n_alerts", "internal"), edges


def graph_top_nodes(nodes: DataFrame, edges: DataFrame, n: int = 60) -> tuple[DataFrame, DataFrame]:
    """The n riskiest nodes (peak, alerts, weighted degree) and the edges among them."""
    ends = edges.select("weight", F.explode(F.array("src", "dst")).alias("host"))
    degree = ends.groupBy("host").agg(F.sum("weight").alias("degree"))
    total = nodes.agg(F.count(F.lit(1))).scalar()
    ranked = nodes.join(degree, "host", "left").fillna(0, subset=["degree"]).withColumn("total", total)
    kept = (ranked.orderBy(F.desc("peak_prob"), F.desc("n_alerts"), F.desc("degree"), "host").limit(n)
            .withColumn("truncated", F.col("total") > n))
    hosts = kept.select("host")
    inner = (edges.join(hosts.withColumnRenamed("host", "src"), "src", "left_semi")
             .join(hosts.withColumnRenamed("host", "dst"), "dst", "left_semi"))
    return kept, inner


def network_timeline(alerts: DataFrame) -> DataFrame:
    """Per window the highest host score with its host and stage (ties: lowest host)."""
    best = alerts.groupBy("window_start").agg(
        F.min(F.struct((-F.col("probability")).alias("neg"), "host", "stage")).alias("b"))
    return best.select("window_start", (-F.col("b.neg")).alias("probability"), "b.host", "b.stage")


def host_ranking(alerts: DataFrame, top: int = 10) -> DataFrame:
    """Hosts by peak score, with alert count and most frequent stage (lowest on ties)."""
    per = alerts.groupBy("host").agg(
        F.max("probability").alias("peak_probability"), F.count(F.lit(1)).alias("alerts"),
        F.mode("stage", True).alias("stage"))
    return per.orderBy(F.desc("peak_probability"), "host").limit(top)


def top_alert_per_host(alerts: DataFrame) -> DataFrame:
    """The highest-probability alert of each host (earliest on ties)."""
    rest = [c for c in alerts.columns if c not in ("host", "probability")]
    best = alerts.groupBy("host").agg(F.min(F.struct(
        (-F.col("probability")).alias("neg"), "window_start",
        *[c for c in rest if c != "window_start"])).alias("b"))
    return best.select("host", (-F.col("b.neg")).alias("probability"), *[F.col(f"b.{c}") for c in rest])


def run_summary(flows: DataFrame, wf: DataFrame, alerts: DataFrame, coverage: DataFrame | None,
                threshold: float, keyed: bool) -> DataFrame:
    """One row of run facts, also when nothing fired.

    ``coverage`` None means the drop history is unknown: NULL, never zero.
    """
    spark = wf.sparkSession
    one = F.count(F.lit(1))
    unparsed = (F.lit(None).cast("long") if coverage is None
                else coverage.agg(F.sum("n").alias("n")).scalar())
    emitted = alerts.select("host")
    return spark.range(1).select(
        flows.agg(one).scalar().alias("n_flows"), wf.agg(one).scalar().alias("n_host_windows"),
        alerts.agg(one).scalar().alias("n_alerts"), F.lit(float(threshold)).alias("threshold"),
        unparsed.alias("unparsed_frames"),
        hosts_pseudonymised(emitted).select("pseudonymised").scalar().cast("int").alias("hosts_pseudonymised"),
        F.lit(int(not keyed)).alias("role_features_degraded"))
