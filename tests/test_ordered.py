from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostwatch.functions.columns import floor_div
from hostwatch.operators import ordered as od


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    return [(0 if r.random() < 0.5 else r.randint(1, 3), r.randrange(500), i, float(r.choice([1, 2, 2, 5, 9, r.random()])))
            for i in range(900)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k long, t long, i long, v double")


def in_order(rows, k):
    return sorted([r for r in rows if r[0] == k], key=lambda r: (r[1], r[2]))


def test_previous_row(df, rows):
    got = {r.i: r.prev_v for r in od.previous_row(df, ["k"], floor_div("t", 37), ["t", "i"], ["v"]).collect()}
    for k in range(4):
        seq = in_order(rows, k)
        assert got[seq[0][2]] is None
        assert all(got[b[2]] == a[3] for a, b in zip(seq, seq[1:]))


def test_row_numbers_and_running_total(df, rows):
    got = {r.i: r.row_no for r in od.row_numbers(df, ["k"], floor_div("t", 50), [F.col("t"), F.col("i")]).collect()}
    tot = {r.i: r.s for r in od.running_total(df, [], floor_div("t", 50), [F.col("t"), F.col("i")], {"s": F.col("t")}).collect()}
    for k in range(4):
        assert [got[r[2]] for r in in_order(rows, k)] == list(range(1, len(in_order(rows, k)) + 1))
    everything = sorted(rows, key=lambda r: (r[1], r[2]))
    assert [tot[r[2]] for r in everything] == list(np.cumsum([r[1] for r in everything]))


@pytest.mark.parametrize("descending", [False, True])
def test_cumulative(df, rows, descending):
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {(r.k, r.v): r.cum_n for r in od.cumulative(counts, ["k"], "v", ["n"], descending).collect()}
    for (k, v), n in got.items():
        vals = [r[3] for r in rows if r[0] == k]
        assert n == sum((x >= v) if descending else (x <= v) for x in vals)


def test_exact_percentiles(df, rows):
    got = {r.k: (r.a, r.b) for r in od.exact_percentiles(df, ["k"], "v", {"a": .5, "b": .99}).collect()}
    for k in range(4):
        vals = [r[3] for r in rows if r[0] == k]
        assert got[k] == pytest.approx((np.percentile(vals, 50), np.percentile(vals, 99)))


def test_latest_before_is_strict(spark, df, rows):
    events = df.select("k", F.col("t").alias("et"), F.col("v").alias("val"), "i")
    reads = spark.createDataFrame([(k, t) for k in range(5) for t in range(-5, 520, 7)], "k long, rt long")
    got = {(r.k, r.rt): r.val for r in od.latest_before(events, reads, "k", "et", "rt", "val", 64, "i").collect()}
    assert len(got) == 5 * len(range(-5, 520, 7))
    for (k, t), v in got.items():
        past = [r for r in in_order(rows, k) if r[1] < t] if k < 4 else []
        assert v == (past[-1][3] if past else None)
