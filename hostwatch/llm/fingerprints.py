"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections.

Leaves are sentences (a run up to its closing marks or line ends; longer ones in pieces), hashed by SHA-256. A line end closes a
paragraph. A blank line closes a section, and so does a paragraph whose last leaf has a 64-bit hash divisible by 8: borders depend on
content, so an insertion moves no other border. A paragraph's digest is the SHA-256 of its leaf hashes, a section's of
its paragraph digests, the root's of its section digests. The fingerprint is written as

    root:leaf leaf/leaf|leaf   (hexadecimal without blanks; / closes a paragraph, | a section)

The root rests on whole hashes, so equal roots mean equal texts; of each leaf 16 digits are written, 17 characters for 48
of text at most. Unequal trees are compared from sections down: sections with equal digests are equal, and only the leaves of
the others are looked at. Likeness is a Dice measure: twice the leaves shared over the sum of both counts, each distinct section and, in
sections that differ, each distinct leaf counted once; two empty texts are alike by 1. All sets are hashed, so very long texts take time in
proportion to their length.

A null text is an empty one: no leaf. Rows that agree in doc_id and text count as one document among neighbours and
each keep their row. Null doc_ids come last in descending order. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A sentence, or 48 code points of a longer one.
LEAF = r"[^.!?\n]{1,48}[.!?\n]*|[.!?\n]+"
SECTION_EVERY = 8
ROWS_PER_RANGE = 20_000


def tree(text: Column) -> Column:
    """All leaves with their borders: 64 hex digits a leaf, / after a paragraph, | after a section."""

    def leaf(x):
        border = F.when(~x.endswith("\n"), F.lit("")).when(
            x.endswith("\n\n") | (F.pmod(F.xxhash64(x), F.lit(SECTION_EVERY)) == 0), F.lit("|")).otherwise(F.lit("/"))
        return F.concat(F.sha2(F.encode(x, "utf-8"), 256), border)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(LEAF), F.lit(0)), leaf), "")


def shown(leaves: Column) -> Column:
    """The first 16 digits of every leaf, borders kept."""
    return F.regexp_replace(leaves, "([0-9a-f]{16})[0-9a-f]{48}", "$1")


def section_digest(section: Column) -> Column:
    return F.sha2(F.encode(F.array_join(
        F.transform(F.split(section, "/"), lambda p: F.sha2(F.encode(p, "utf-8"), 256)), ""), "utf-8"), 256)


def sections(leaves: Column) -> Column:
    """Digest of every section."""
    return F.transform(F.split(leaves, r"\|"), section_digest)


def fingerprint(leaves: Column) -> Column:
    root = F.sha2(F.encode(F.array_join(sections(leaves), ""), "utf-8"), 256)
    return F.concat(root, F.lit(":"), shown(leaves))


def branches(leaves: Column) -> Column:
    """Every section as its digest (64 digits) and then 16 digits for each of its leaves."""
    return F.transform(F.split(leaves, r"\|"), lambda s: F.concat(section_digest(s), F.replace(shown(s), F.lit("/"), F.lit(""))))


def leaves_apart(one: Column, other: Column) -> Column:
    """Distinct leaves of the branches of ``one`` that ``other`` has not."""
    cut = lambda s: F.regexp_extract_all(F.substring(s, 65, 2 ** 31 - 1), F.lit(".{16}"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(F.array_except(one, other), cut)))


def likeness(one: Column, other: Column) -> Column:
    """Dice measure of two trees, given as branches: equal sections in one step, leaves where sections differ."""
    same = F.aggregate(F.array_intersect(one, other), F.lit(0).cast("long"), lambda n, s: n + common.div(F.char_length(s) - 64, 16))
    here, there = leaves_apart(one, other), leaves_apart(other, one)
    whole = same * 2 + F.size(here) + F.size(there)
    return F.when(whole == 0, 1.0).otherwise((same + F.size(F.array_intersect(here, there))) * 2.0 / whole)


def edited_places(one: Column, other: Column) -> Column:
    """Edits located: (section, paragraph) numbers from 0 in ``one`` whose paragraph is not in ``other``.

    Sections of ``one`` with a digest that ``other`` has as well are skipped without looking at their paragraphs.
    """
    known = F.split(F.replace(other, F.lit("|"), F.lit("/")), "/")
    return F.flatten(F.transform(F.arrays_zip(F.split(one, r"\|").alias("s"), sections(one).alias("d")), lambda x, i: F.when(
        F.array_contains(sections(other), x["d"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
        F.filter(F.transform(F.split(x["s"], "/"), lambda p, j: F.when(~F.array_contains(known, p), F.struct(
            i.cast("int").alias("section"), j.cast("int").alias("paragraph")))), lambda y: y.isNotNull()))))


def neighbours(keys: DataFrame) -> DataFrame:
    """Every (doc_id, h) with the one that follows by descending doc_id; the first follows the last.

    ``keys`` has one row per (doc_id, h). Ranges of the order are dealt to tasks and written; only the first row of
    each range crosses to the range before it.
    """
    n = keys.count()
    order = [F.col("doc_id").desc_nulls_last(), F.col("h").asc()]
    ranged = keys.repartitionByRange(max(16, -(-n // ROWS_PER_RANGE)), *order).withColumn("part", F.spark_partition_id())
    ranged = common.staged(ranged, "doc-order")
    inside = Window.partitionBy("part").orderBy(*order)
    key = F.struct("doc_id", "h")
    ranged = ranged.withColumn("own", F.lead(key).over(inside)).withColumn("no", F.row_number().over(inside))
    firsts = ranged.filter("no = 1").select("part", key.alias("first"))
    along = Window.partitionBy(F.lit(0)).orderBy("part")
    everything = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(along), F.first("first").over(everything)).alias("after"))
    return ranged.join(common.small(after), "part").select(
        "doc_id", "h", "n_chars", F.coalesce("own", "after").alias("next"))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, next_branches for every row of ``docs`` (doc_id, text).

    The edited text: the last third (rounded down) of the code points gives way to as many first ones of the next
    document by descending doc_id. Texts are dealt out once, by (doc_id, hash of the text); a document hands only the
    asked prefix and its tree's branches to the one before it.
    """
    text = common.text_of()
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))
    found = common.staged(rows.groupBy("doc_id", "h").agg(
        F.max(F.char_length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("rows")), "doc-keys")
    order = neighbours(found.select("doc_id", "h", "n_chars"))
    asked = order.select(F.col("next.doc_id").alias("asked_id"), F.col("next.h").alias("asked_h"),
                         F.col("doc_id").alias("for_id"), F.col("h").alias("for_h"), common.div(F.col("n_chars"), 3).alias("k"))
    handed = rows.join(asked, rows["doc_id"].eqNullSafe(asked["asked_id"]) & (rows["h"] == asked["asked_h"])).select(
        "for_id", "for_h", "k", branches(tree(F.col("text"))).alias("next_branches"),
        F.substring(F.col("text"), F.lit(1), F.col("k").cast("int")).alias("prefix"))
    if found.filter("rows > 1").limit(1).count():
        handed = handed.dropDuplicates(["for_id", "for_h"])
    out = rows.join(handed, rows["doc_id"].eqNullSafe(handed["for_id"]) & (rows["h"] == handed["for_h"]))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.char_length("text") - F.col("k")).cast("int")), F.col("prefix"))
    return out.select("doc_id", "text", "next_branches", edited.alias("edited"))


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    out = with_edits(common.documents(spark, sf_dir).select("doc_id", "text"))
    out = out.select("doc_id", F.char_length("text").cast("long").alias("n_chars"),
                     F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
                     tree(F.col("text")).alias("leaves"), tree(F.col("edited")).alias("edited_leaves"), "next_branches")
    out = out.select("*", branches(F.col("leaves")).alias("own"), branches(F.col("edited_leaves")).alias("own_edited"))
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("leaves")).alias("fingerprint"),
                      fingerprint(F.col("edited_leaves")).alias("edited_fingerprint"),
                      likeness(F.col("own"), F.col("own_edited")).alias("near_edited"),
                      likeness(F.col("own"), F.col("next_branches")).alias("near_next"),
                      F.size(F.array_except("own", "own_edited")).alias("changed_sections"))
