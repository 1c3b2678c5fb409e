"""Stage and technique rules compiled to CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import STAGE_RULES, TECHNIQUES, UNCLASSIFIED
from .columns import as_col

RULE_REF = "stage_rule:"


def infer_stage(rules: dict = STAGE_RULES) -> Column:
    """Coarse stage of a window row from its named features; first rule wins."""
    r, c = rules, F.col
    bulk = (
        (c("sent_bytes") > r["exfiltration_sent_bytes_gt"])
        & (c("distinct_dst_ips") <= r["exfiltration_distinct_dst_ips_lte"])
        & (c("syn") < r["exfiltration_syn_lt"])
    )
    sweep = (
        (c("distinct_dst_ports") > r["scan_distinct_dst_ports_gt"])
        | (c("sequential_port_ratio") > r["scan_sequential_port_ratio_gt"])
    )
    return (
        F.when(bulk, "exfiltration")
        .when(sweep & (c("internal") == 1), "lateral_movement")
        .when(sweep, "recon")
        .when((c("syn") > r["initial_access_syn_gt"]) & (c("ack") < c("syn")), "initial_access")
        .when(c("sent_pkts") > r["impact_sent_pkts_gt"], "impact")
        .otherwise(UNCLASSIFIED)
    )


def _condition(when: dict, stage_rules: dict, available: set[str] | None) -> Column:
    if not when:
        raise ValueError("a technique rule without conditions matches every window")
    tests = []
    for key, threshold in when.items():
        feature, _, suffix = key.rpartition("_")
        if suffix != "gt" or not feature:
            raise ValueError(f"rule key {key!r} names no supported comparison (<feature>_gt)")
        if isinstance(threshold, str):
            if not threshold.startswith(RULE_REF) or threshold[len(RULE_REF):] not in stage_rules:
                raise KeyError(f"rule {key!r} references unknown threshold {threshold!r}")
            threshold = stage_rules[threshold[len(RULE_REF):]]
        present = available is None or feature in available
        value = F.coalesce(F.col(feature), F.lit(0.0)) if present else F.lit(0.0)
        tests.append(value > F.lit(threshold))
    return reduce(lambda a, b: a & b, tests)


def map_technique(stage: str | Column, stage_rules: dict = STAGE_RULES, techniques: dict = TECHNIQUES,
                  available: set[str] | None = None) -> Column:
    """STRUCT<technique, name> of a stage; an unmapped stage fails the query."""
    stage = as_col(stage)

    def entry(technique, name):
        return F.struct(F.lit(technique).cast("string").alias("technique"),
                        F.lit(name).alias("name"))

    out = None
    for stage_name, (default, default_name, rules) in techniques.items():
        branch = None
        for when, technique, name in rules:
            cond = _condition(when, stage_rules, available)
            value = entry(technique, name)
            branch = F.when(cond, value) if branch is None else branch.when(cond, value)
        tail = entry(default, default_name)
        branch = tail if branch is None else branch.otherwise(tail)
        test = stage == stage_name
        out = F.when(test, branch) if out is None else out.when(test, branch)
    unknown = F.raise_error(F.concat(F.lit("stage without technique entry: "), stage))
    return out.otherwise(unknown.cast("struct<technique:string,name:string>"))


def attack_family(name: str | Column) -> Column:
    """Coarse attack family of a timeline attack name; first test wins."""
    n = F.lower(as_col(name))
    return (
        F.when(n.contains("brute"), "bruteforce")
        .when(n.contains("ddos"), "ddos")
        .when(n.startswith("dos"), "dos")
        .when(n.contains("infiltration"), "infiltration")
        .when(n.contains("bot"), "bot")
        .when(n.contains("web") | n.contains("xss") | n.contains("sql"), "web")
        .otherwise("other")
    )
