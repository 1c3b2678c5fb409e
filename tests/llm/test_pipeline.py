"""The pipeline's stages against plain versions."""

from __future__ import annotations

import collections

import corpus_pipeline
from hostwatch.llm import common

from . import brute
from .test_operators import ROWS, SF, check_bpe, odd, write  # noqa: F401


def test_stages_on_a_whole_table(spark):
    docs = common.documents(spark, SF)
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = common.staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept.append(docs.collect())
    before = [(r.doc_id, r.text) for r in common.documents(spark, SF).collect()]
    assert {r.doc_id for r in kept[0]} == {d for d, t in before if any(c.isalpha() for c in t)}
    rows = [(r.doc_id, r.text) for r in kept[0]]
    want = {d: text for (d, _), (text, _, _) in zip(rows, brute.kept_lines(rows))}
    assert {r.doc_id: r.text for r in kept[1]} == want and all(r.n_chars == len(r.text) for r in kept[1])
    rows = sorted(want.items())
    assert {r.doc_id for r in kept[2]} == {d for (d, _), (n, c) in zip(rows, brute.components(rows)) if n == 0 or c == d}
    mixed = common.staged(corpus_pipeline.mix_sources(spark, docs, SF), "mix")
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(copies) <= {r.doc_id for r in kept[2]} and max(copies.values()) <= 3
    out = corpus_pipeline.encode_text(spark, mixed, SF)
    check_bpe([r.asDict() for r in out.collect()], [(r.doc_id, r.text) for r in mixed.collect()])


def test_run_on_odd_and_empty_tables(spark, odd, tmp_path):  # noqa: F811
    out = corpus_pipeline.run(spark, odd).collect()
    ids = {r.doc_id for r in out}
    assert ids and not ids & {2, 3, 4, 9} and len({r.doc_id for r in out if r.doc_id in (10, 11, 12)}) <= 1
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [])).collect() == []


def test_one_of_a_group_of_repeated_rows_stays(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (2, ""), (2, ""), (None, "lone words")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(
        {(1, rows[0][1]): 1, (2, ""): 2, (None, "lone words"): 1})
