"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share all words by weight; a target stops at ``most`` times its source's words and the excess is
shared again by weight until none is above. Closed form: sort sources by most * size / weight; those whose cap lies
below the common level stop there, the others get level * weight.

Taking: with r = target / source words every document is taken whole floor(r) times. The rest of the target is drawn
without replacement: document i has inclusion probability p_i = min(1, (r - floor(r)) * w_i), a uniform number u_i
from a digest of the row, and rank Q_i = [u_i / (1 - u_i)] / [p_i / (1 - p_i)] (Pareto order sampling). The sample has
a fixed size in words: documents are taken in the order of Q while their words fit; then the one document left whose
words come nearest to the gap is taken if that brings the source nearer to its target. w_i = sqrt(m / (m + size_i)) *
sqrt 2 with m the mean size: long documents already carry many words and repeat a little less readily.

The order is never sorted whole: Q is cut into buckets per source, sums of buckets tell the one bucket in which the
target falls, and only that bucket is ordered. A hot source is split over its buckets. Tables of one row per source
are broadcast only after their rows were counted.

Repeated rows (equal doc_id, text and source) are numbered 0, 1, 2, ...; the number is part of their key, so each has a chance of
its own, copies lie in buckets of their own and the boundary may fall between two of them. They are numbered inside the parts of
the table and the parts carried on by counts, so no task gathers them.

Null text or one without words: size 0, taken 0. A null source is a source of its own, last in order. Rows that tie on rank
are ordered by size and key. Empty table: empty result. Reruns agree, as u depends on the row and its number alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 6


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source: source, source_no, source_size, docs, target. ``sizes`` has source and size.

    The table has one row per source of the mixture; ordering it is one small task.
    """
    table = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    table = table.withColumn("source_no", F.row_number().over(order) - 1)
    given = F.array(*[F.lit(float(w)) for w in weights])
    table = table.withColumn("weight", F.element_at(given, (F.col("source_no") % len(weights) + 1).cast("int")))
    table = table.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy(F.lit(0))
    tight = everything.orderBy(F.col("cap") / F.col("weight"), "source_no")
    upto = tight.rowsBetween(Window.unboundedPreceding, -1)
    onward = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # level if all sources from this one on were below their caps and all before it at them
    table = table.select("*", F.sum("source_size").over(everything).cast("double").alias("total"),
                         F.coalesce(F.sum("cap").over(upto), F.lit(0.0)).alias("capped"),
                         F.sum("weight").over(onward).alias("open"))
    table = table.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return table.withColumn("level", level).select(
        "source", "source_no", "source_size", "docs",
        F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def uniform(identity: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from a digest of the row."""
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), identity), "utf-8"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(rows: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, per_bucket: int = 50_000) -> DataFrame:
    """``rows``: row_key, source, size, u (0 to 1). Adds source_size, target and taken (words, repeats counted)."""
    targets = common.small(source_targets(rows, weights, most))
    rows = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio + 1e-9).cast("long"))
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    mean = F.col("source_size") / F.col("docs")
    tilt = F.when(F.col("size") > 0, F.sqrt(2.0 * mean / (mean + F.col("size")))).otherwise(1.0)
    rows = rows.withColumn("rest", rest).withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio - F.col("whole")) * tilt))
    q = (F.when(F.col("p") >= 1.0, 0.0).when(F.col("p") <= 0.0, F.lit(float("inf")))
         .otherwise((F.col("u") / (1.0 - F.col("u"))) / (F.col("p") / (1.0 - F.col("p")))))
    # buckets of equal chance: u as it would be were all p equal to one half
    buckets = F.least(F.lit(1 << 20).cast("long"), F.lit(64) + common.div(F.col("docs"), per_bucket))
    near = F.when(q == float("inf"), 1.0).otherwise(q / (1.0 + q))
    rows = rows.withColumn("q", q).withColumn("bucket", F.floor(near * buckets).cast("long"))
    rows = common.staged(rows, "mix-rows")
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    sums = common.before(sums, ["source_no"], "bucket", "words", "base")
    # the bucket in which the rest of the target ends
    ends = common.small(sums.filter((F.col("base") <= F.col("rest")) & (F.col("base") + F.col("words") > F.col("rest")))
                        .select("source_no", F.col("bucket").alias("end_bucket"), F.col("base").alias("end_base")))
    rows = rows.join(ends, "source_no", "left")
    at_end = F.col("bucket") == F.col("end_bucket")
    order = Window.partitionBy("source_no", "bucket").orderBy("q", "size", "row_key")
    cut = (rows.filter(at_end).select("row_key", "source_no", "bucket", "size", "q", "end_base", "rest")
           .withColumn("upto", F.col("end_base") + F.sum("size").over(
               order.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    # last document that fits, in order; no row of the bucket may fit
    last = cut.groupBy("source_no").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("q", "size", "row_key"))).alias("last"),
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("fits"), F.first("end_base").alias("end_base"),
        F.first("rest").alias("rest"))
    last = common.small(last.select("source_no", "last", (F.col("rest") - F.coalesce("fits", "end_base")).alias("gap")))
    rows = rows.join(last, "source_no", "left")
    inside = (F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket"))
              | (at_end & F.col("last").isNotNull() & (F.struct("q", "size", "row_key") <= F.col("last"))))
    rows = rows.withColumn("inside", F.coalesce(inside, F.lit(False)) & (F.col("rest") > 0))
    left = rows.filter(~F.col("inside") & (F.col("rest") > 0) & (F.col("size") > 0)
                       & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
    filler = common.small(left.groupBy("source_no").agg(
        F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "q", "row_key")).alias("filler"))
        .select("source_no", F.col("filler.row_key").alias("filler_key")))
    rows = rows.join(filler, "source_no", "left")
    more = F.col("inside") | F.coalesce(F.col("row_key") == F.col("filler_key"), F.lit(False))
    rows = rows.withColumn("copies", F.col("whole") + more.cast("long"))
    return rows.withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def row_key() -> Column:
    """doc_id and a digest of the text: rows that agree in it and in source are repeated rows."""
    digest = F.md5(F.encode(common.text_of(), "utf-8"))
    return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digest)


def numbered(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (row_key and more) staged, with a row_key of its own for every repeated row, and u."""
    rows = common.staged(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    of_source = F.concat("row_key", F.coalesce(F.concat(F.lit("|s"), F.col("source").cast("string")), F.lit("|")))
    own = rows.select(of_source.alias("row_key"), "_row", F.shiftright("_row", 33).alias("_part"))
    parts = own.groupBy("row_key", "_part").agg(F.count(F.lit(1)).alias("n"))
    repeated = parts.groupBy("row_key").agg(F.sum("n").alias("all")).filter("`all` > 1").select("row_key")
    base = common.before(parts.join(repeated, "row_key"), ["row_key"], "_part", "n", "base").select("row_key", "_part", "base")
    inside = Window.partitionBy("row_key", "_part").orderBy("_row")
    copies = own.join(base, ["row_key", "_part"]).select("_row", (F.col("base") + F.row_number().over(inside) - 1).alias("_copy"))
    out = rows.join(common.small(copies.filter("_copy > 0")), "_row", "left")
    key = F.concat("row_key", F.coalesce(F.concat(F.lit("#"), F.col("_copy").cast("string")), F.lit("")))
    return out.withColumn("row_key", key).drop("_row", "_copy").withColumn("u", uniform(F.col("row_key"), seed))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``row`` (all columns of a document), with size, source_size, target, taken and copies."""
    return mix(numbered(docs.select(F.struct(*docs.columns).alias("row"), "source", common.word_count(F.col("text")).alias("size"),
                                    row_key().alias("row_key")), seed))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    out = mix_documents(docs, seed).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1."""
    docs = common.documents(spark, sf_dir)
    rows = docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"), row_key().alias("row_key"))
    return mix(numbered(rows)).select("doc_id", "size", "source_size", "target", "taken")
