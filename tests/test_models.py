from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostwatch.config import Grid
from hostwatch.operators import metrics as me
from hostwatch.operators import models as ml
from hostwatch.sources import stores as st

GRID = Grid()
FEATS = ["p", "q", "flat"]


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    r = random.Random(3)
    rows = []
    for i in range(1200):
        split = ("train", "val", "test")[i % 3]
        attack = r.random() < .2
        rows.append((split, f"h{i % 5}", i, i * 5, split, "impact" if attack else "benign",
                     r.gauss(2.0 * attack, 1), r.gauss(0, 3), 7.0))
    df = spark.createDataFrame(rows, "split string, host string, window_id long, window_start long, day string, stage string, p double, q double, flat double")
    path = str(tmp_path_factory.mktemp("labelled"))
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_scaler_is_train_only_and_population(labelled):
    train, scaler = ml.assemble_split(labelled, "train", FEATS)
    x = [r.p for r in labelled.filter("split = 'train'").collect()]
    assert scaler["p"] == pytest.approx((np.mean(x), np.std(x))) and scaler["flat"] == (7.0, 1.0)
    assert train.agg(F.stddev_pop("p")).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        ml.assemble_split(labelled, "val", FEATS)


def test_weights(labelled):
    df = labelled.withColumn("y", (F.col("stage") != "benign").cast("int"))
    w = ml.class_weights(df).first()
    pos = df.filter("y = 1").count()
    assert w.w_attack == pytest.approx(w.n / (2 * pos)) and w.pos_weight == pytest.approx((w.n - pos) / pos)


def test_models_rank_and_registry(labelled):
    for name, params in (("logistic", {}), ("trees", {"trees": 5, "depth": 3})):
        s = ml.train_and_score(labelled, FEATS, name, **params)
        area = {r.split: r.auroc for r in me.auroc(s, ["split"]).collect()}
        assert set(area) == {"val", "test"} and min(area.values()) > .8, name
    assert set(ml.MODELS) == {"logistic", "trees"}


def test_single_class_refused(labelled):
    with pytest.raises(ValueError, match="single-class"):
        ml.train_and_score(labelled.withColumn("stage", F.lit("benign")), FEATS)
    with pytest.raises(ValueError):
        ml.split_comparison(labelled, FEATS, 0)


def test_split_comparison_without_structure(labelled):
    out = {r.arm: r for r in ml.inflation(ml.split_comparison(labelled, FEATS, 2)).collect()}
    assert set(out) == {"disjoint", "random"} and abs(out["random"].inflation) < .1


def test_horizon_heads_have_their_own_thresholds(labelled):
    heads, table = ml.fit_horizon_heads(labelled, FEATS, GRID, (0, 15), (.05,), "logistic")
    rows = {(r.variant, r.k): r for r in table.collect()}
    assert set(rows) == set(heads) == {("full", 0), ("flow", 0), ("full", 15), ("flow", 15)}
    assert rows["full", 15].seconds_ahead == 75 and rows["full", 0].val_auroc > .8


def test_store_of_heads_and_thresholds(spark, labelled, tmp_path):
    """Versions are kept apart, heads score as before, a missing key raises."""
    path = str(tmp_path / "heads")
    heads, table = ml.fit_horizon_heads(labelled, FEATS, GRID, (0, 15), (.05, .2), "logistic")
    with pytest.raises(FileNotFoundError):
        st.read_thresholds(spark, path)
    assert st.write_heads(heads, table, path) == 1
    assert st.write_heads(heads, table.withColumn("threshold", F.col("threshold") + 1), path) == 2
    want = {(r.variant, r.k, r.budget): r.threshold for r in table.collect()}
    assert len(want) == 8
    for (variant, k, budget), threshold in want.items():
        assert st.threshold_for(spark, path, variant, k, budget, 1) == pytest.approx(threshold)
        assert st.threshold_for(spark, path, variant, k, budget) == pytest.approx(threshold + 1)
    with pytest.raises(KeyError, match="full/4"):
        st.threshold_for(spark, path, "full", 4, .05)
    with pytest.raises(KeyError, match="flow/1"):
        st.read_head(spark, path, "flow", 1)
    with pytest.raises(FileNotFoundError):
        st.read_thresholds(spark, path, 7)
    rows = ml.assemble_split(labelled, "train", FEATS)[0]
    a, b = (ml.score(m, rows, FEATS).agg(F.sum("score")).first()[0] for m in (heads["full", 0], st.read_head(spark, path, "full", 0)))
    assert a == pytest.approx(b)



def test_explanations(spark, labelled):
    train, scaler = ml.assemble_split(labelled, "train", FEATS)
    lin = ml.explain_linear(labelled, {"p": 2.0, "q": -1.0, "flat": 5.0}, scaler, 2).filter("rank = 1").collect()
    raw = {(r.host, r.window_start): r for r in labelled.collect()}
    for r in lin[:40]:
        src = raw[r.host, r.window_start]
        want = {"p": 2 * (src.p - scaler["p"][0]) / scaler["p"][1], "q": -(src.q - scaler["q"][0]) / scaler["q"][1], "flat": 0.0}
        top = max(want, key=lambda f: abs(want[f]))
        assert (r.feature, r.contribution) == (top, pytest.approx(want[top]))
    model = ml.fit_logistic(train, FEATS)
    strong = ml.apply_scaler(labelled.filter("p > 3"), scaler)
    occ = ml.explain_occlusion(model, strong, FEATS, 1).collect()
    assert {r.feature for r in occ} == {"p"} and all(r.contribution > 0 for r in occ)


def test_calibration_is_monotone_and_stack_fits_val(labelled):
    rows = ml.train_and_score(labelled, FEATS).withColumnRenamed("score", "raw")
    cal = ml.isotonic_calibrate(rows, "raw").orderBy("raw").collect()
    probs = [r.probability for r in cal]
    assert all(a <= b + 1e-12 for a, b in zip(probs, probs[1:]))
    stacked = ml.fuse_stack(rows.withColumn("other", F.rand(1)), ["raw", "other"])
    assert me.auroc(stacked.filter("split = 'test'"), ["split"]).first().auroc > .75


def test_snapshot_head_uses_all_attacks_and_n_benign(labelled):
    rows = labelled.withColumn("y", (F.col("stage") != "benign").cast("int"))
    assert ml.head_on_snapshot(rows, ["p", "q"], 50).coefficients[0] > 0


def test_rows_of_model_jobs_are_made_once(labelled, tmp_path):
    """rows that are gone over many times are cut once, and give the same results."""
    made = []

    def cut(df):
        made.append(str(tmp_path / f"cut{len(list(tmp_path.iterdir()))}"))
        df.write.parquet(made[-1])
        return df.sparkSession.read.parquet(made[-1])

    rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rows(ml.split_comparison(labelled, FEATS, 2, cut=cut)) == rows(ml.split_comparison(labelled, FEATS, 2))
    assert len(made) == 3                                  # the pool and two drawn orders
    made.clear()
    tables = [ml.fit_horizon_heads(labelled, FEATS, GRID, (0, 15), (.05,), "logistic", **more)[1] for more in ({"cut": cut}, {})]
    assert rows(tables[0]) == rows(tables[1]) and len(made) == 4
