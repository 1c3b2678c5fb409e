"""Filter audit against applying every order; toxicity on held-out labels and odd rows."""

from __future__ import annotations

import collections
import itertools
import re
import zlib

import numpy as np
import pytest

from hostwatch.llm import filter_audit as fa
from hostwatch.llm import toxicity as tx
from hostwatch.llm.queries import QUERIES

from . import brute
from .test_operators import LONG, ROWS, SF, none, odd  # noqa: F401


def applied(docs, labels):
    """{(part, order, step): row} by filtering the documents of each part, order by order."""
    good, toxic, first = set(), set(), {}
    for d, q, t in labels:
        if d is not None:
            good |= {d} if q == 1 else set()
            toxic |= {d} if t == 1 else set()
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    parts = collections.defaultdict(list)
    for d, text, source in docs:
        text, words = text or "", brute.words(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": d is not None and d > first[text]}
        parts[source or ""].append((fails, d in good, d in toxic))
    out = {}
    for part, rows in parts.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[0][f] for r in rows) - len(gone),
                    sum(r[0][f] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return out


@pytest.mark.parametrize("table", ["whole", "odd"])
def test_audit_equals_applying_the_filters(spark, odd, table):  # noqa: F811
    folder = SF if table == "whole" else odd
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    rows = QUERIES["op12_filter_audit"](spark, folder).collect()
    got = {(r.part, r.filter_order, r.step): [r[c] for c in fa.COLUMNS] for r in rows}
    assert got == applied(docs, labels) and len(rows) == len(got)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op13_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.score, label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    bad, good = ([s for s, y, _ in held if y == k] for k in (1, 0))
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.9
    assert np.mean([p for _, y, p in held if y == 1]) > 0.7 and np.mean([p for _, y, p in held if y == 0]) < 0.05
    again = {r.doc_id: r.score for r in QUERIES["op13_toxicity"](spark, sf).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_toxicity_of_odd_rows(spark, odd):  # noqa: F811
    rows = QUERIES["op13_toxicity"](spark, odd).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    texts = ["a plain sentence of words that go on", None, "", "x", LONG, "\x00\ud7ff odd 😀 " * 50]
    docs = spark.createDataFrame([(i, t, 3.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    assert {r.score for r in tx.predict(docs, None).collect()} == {0.0}
    kinds = spark.createDataFrame([(i, 1) for i in range(6)], "doc_id long, toxic int")
    assert tx.learn(docs.drop("score"), kinds) is None


def test_toxicity_learns_a_word_in_any_place():
    """Windows that hold a word of toxic texts only; copies and case do not matter."""
    r = np.random.default_rng(1)
    syllables = ["ta", "ro", "mi", "len", "sko", "vu", "ban", "ter"]
    word = lambda: "".join(r.choice(syllables, r.integers(2, 5)))
    texts, labels = [], []
    for i in range(240):
        words = [word() for _ in range(80)]
        if i % 4 == 0:
            for at in r.integers(0, 80, 4):
                words[at] = "Grumblefink"
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = tx.fit(texts, np.array(labels), 0.25)
    fresh = [" ".join([word() for _ in range(50)]) for _ in range(60)]
    marked = [t + " grumblefink " + t[:90] + " you grumblefink" for t in fresh]
    assert model.score(marked).mean() > model.score(fresh).mean() + 0.4
    assert model.score([""]).shape == (1,) and model.score([None])[0] == model.score([""])[0]
