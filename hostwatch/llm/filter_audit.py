"""Audit of how text filters interact, by contractions of a contingency tensor.

One scan marks for every document which of five filters it fails. Documents are then counted by (part, failed filters): a
tensor of shape 2x2x2x2x2 for each part, axis i telling whether filter i fails, with one measure beside it for all documents, for
those of good quality and for toxic ones. Everything else is a contraction of that tensor with one selector vector an axis: pass
(1, 0), fail (0, 1) or all (1, 1). For the step of an order, axes of earlier filters are contracted with pass, the
step's own axis with fail and later ones with all: that is what the step removes.

Filters (fixed): A under 200 words; B distinct words under half of all; C capital letters A-Z over 2 % of the characters; D any of
#$%&*|; E the text is identical to that of a smaller doc_id anywhere in the table, removed or not.

Documents reach a task only as counts: (part, 32 combinations). Copies are found by a digest of the text: the rows of the least
doc_id of every digest are counted beside all rows, so no copy meets another one and no hot text is gathered.

Null text is an empty one (fails A, passes B, C, D); null source is the part of the empty string. A row without doc_id is a
copy of nothing, nothing is a copy of it and it has no labels. Rows that agree in doc_id and text are no copies of each
other and count each. Of several labels of a doc_id the highest counts; labels other than 0 and 1 count as 0. Texts of any
length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The names of the filters, in the order of the tensor's axes, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
MEASURES = ("n", "good", "toxic")
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS)


def failures(text: Column) -> Column:
    """Bits 0 to 3: whether the text fails A, B, C and D."""
    words = F.filter(F.split(F.translate(text, common.SPACES, " " * len(common.SPACES)), " "), lambda w: w != "")
    both = F.struct(F.size(words).alias("all"), F.size(F.array_distinct(words)).alias("distinct"))
    capitals = F.char_length(text) - F.char_length(F.translate(text, common.UPPER, ""))
    # the words are made once: the struct is the only element of an array that the lambda reads
    of_words = F.transform(F.array(both), lambda c: (c["all"] < LEAST_WORDS).cast("int") + (
        100 * c["distinct"].cast("long") < DISTINCT_PERCENT * c["all"].cast("long")).cast("int") * 2)[0]
    return (of_words + (100 * capitals.cast("long") > CAPITAL_PERCENT * F.char_length(text).cast("long")).cast("int") * 4
            + text.rlike(SYMBOLS).cast("int") * 8)


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, failed (A to D), digest, good, toxic: one narrow row per document, staged."""
    text = common.text_of()
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(text).alias("failed"),
                       F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("digest"))
    rows = common.staged(rows, "audit-rows")
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id would all meet in one task of the join
    named = rows.filter("doc_id is not null").join(known, "doc_id", "left")
    rest = rows.filter("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    return named.unionByName(rest).fillna(0, ["good", "toxic"])


def counts(rows: DataFrame) -> DataFrame:
    """part, failed (A to E), n, good, toxic: the filled cells of the tensors."""
    sums = [F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")]
    whole = rows.groupBy("part", "failed").agg(*sums)
    # the rows of the least doc_id of a text pass E; rows of one doc_id and text are one entry for each part
    own = rows.filter("doc_id is not null").groupBy("digest", "doc_id", "part", "failed").agg(*sums)
    own = own.groupBy("digest", "doc_id").agg(F.collect_list(F.struct("part", "failed", *MEASURES)).alias("cells"))
    first = own.groupBy("digest").agg(F.min_by("cells", "doc_id").alias("cells")).select(F.inline("cells"))
    unnamed = rows.filter("doc_id is null").groupBy("part", "failed").agg(*sums)
    passed = first.unionByName(unnamed).groupBy("part", "failed").agg(*[F.sum(m).alias(f"first_{m}") for m in MEASURES])
    cells = whole.join(passed, ["part", "failed"], "left").fillna(0)
    both = [F.struct(F.col("failed"), *[F.col(f"first_{m}").alias(m) for m in MEASURES]),
            F.struct((F.col("failed") + 16).alias("failed"), *[(F.col(m) - F.col(f"first_{m}")).alias(m) for m in MEASURES])]
    return cells.select("part", F.inline(F.array(*both))).filter("n > 0")


def select(tensor: np.ndarray, selectors: list[np.ndarray]) -> np.ndarray:
    """Contract the five axes of (part, A, B, C, D, E, measure) with a selector each."""
    return np.einsum("pabcdem,a,b,c,d,e->pm", tensor, *selectors, optimize=True)


def steps(tensor: np.ndarray) -> Iterator[tuple[str, int, np.ndarray]]:
    """order, step and the columns of COLUMNS (a row per part) of every order and step."""
    number = len(FILTERS)
    found: dict[tuple[int, frozenset], np.ndarray] = {}

    def removed(own: int, earlier: frozenset) -> np.ndarray:
        if (own, earlier) not in found:
            found[own, earlier] = select(tensor, [PASS if i in earlier else FAIL if i == own else ALL for i in range(number)])
        return found[own, earlier]

    def kept(earlier: frozenset) -> np.ndarray:
        return select(tensor, [PASS if i in earlier else ALL for i in range(number)])[:, 0]

    orders = list(permutations(range(number)))
    fails = [removed(i, frozenset())[:, 0] for i in range(number)]
    only = [removed(i, frozenset(range(number)) - {i})[:, 0] for i in range(number)]
    shapley = [sum(removed(i, frozenset(o[:o.index(i)]))[:, 0] for o in orders) for i in range(number)]
    left = {frozenset(s): kept(frozenset(s)) for o in orders for s in (o[:k] for k in range(1, number + 1))}
    for order in orders:
        for at, own in enumerate(order):
            gone = removed(own, frozenset(order[:at]))
            yield "".join(FILTERS[i] for i in order), at + 1, np.stack(
                (left[frozenset(order[:at + 1])], gone[:, 0], fails[own] - gone[:, 0], only[own], gone[:, 1], gone[:, 2], shapley[own]), axis=1)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step. ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic."""
    cells = counts(marked(docs, labels)).groupBy("part").agg(F.collect_list(F.struct("failed", *MEASURES)).alias("cells"))

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                parts = batch.column("part").slice(low, 64)
                tensor = np.zeros((len(parts), 32, len(MEASURES)), np.int64)
                for i, filled in enumerate(batch.column("cells").slice(low, 64).to_pylist()):
                    for cell in filled:
                        tensor[i, cell["failed"]] += [cell[m] for m in MEASURES]
                # bit 0 is A: the first axis of a C-ordered tensor is the highest bit
                tensor = tensor.reshape(-1, 2, 2, 2, 2, 2, len(MEASURES)).transpose(0, 5, 4, 3, 2, 1, 6)
                for order, step, values in steps(tensor):
                    yield pa.RecordBatch.from_arrays(
                        [parts, pa.array([order] * len(parts)), pa.array([step] * len(parts), pa.int32()),
                         *[pa.array(v, pa.int64()) for v in values.T]], ["part", "filter_order", "step", *COLUMNS])

    return cells.mapInArrow(contract, SCHEMA)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Interaction of the five filters over all documents and sources."""
    return audit(common.documents(spark, sf_dir).select("doc_id", "text", "source"),
                 spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))
