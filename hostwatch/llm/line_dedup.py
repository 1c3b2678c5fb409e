"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of descending doc_id. A batch reduces its lines to one row per key (hash, number of
documents, largest doc_id) and anti-joins them with the runs: keys not in any run are new, and their holder is the
document that keeps the line. Known keys only add to the count. The batch then becomes a run of its own at level 0.
When a level holds ``fan`` runs they are compacted into one run of the next level. A run is a table bucketed and
sorted by the key, so joining and compacting runs are merge joins without a shuffle of them.

After the last batch, keys found in ``least`` documents or more lose all lines except in their holder. Keys are
96 bits (xxhash64 and murmur3 of the normalised line). A key that very many documents share is one row in each run;
its lines are joined by broadcast, and at most 4096 keys can be that frequent.

Null or empty text: one empty line, kept. Null doc_id: smaller than any other; rows of equal doc_id count as
documents of their own and keep or lose a line alike. Empty table: empty result. A very long text is one row; its lines are
matched with its own lost keys in groups, so the work is lines times the root of the lost keys. The tables of the runs
are dropped from the catalog at the end, also after a failure.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_CHARS, LEAST_DOCS = 20, 3
HOT_KEYS = 4096


def line_key(line: Column) -> Column:
    return common.lower_ascii(F.btrim(line, F.lit(common.SPACES)))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h"), F.hash(key).alias("c"))


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """Distinct long line keys of every row: doc_id, salt, h, c."""
    keys = F.transform(F.filter(F.split(common.text_of(), "\n"), lambda x: F.char_length(x) >= least_chars), line_key)
    keys = F.transform(F.filter(keys, lambda k: F.char_length(k) >= least_chars), key_hash)
    return docs.select("doc_id", "salt", F.explode(F.array_distinct(keys)).alias("key")).select("doc_id", "salt", "key.h", "key.c")


class LineRuns:
    """Runs by level; each is a table (h, c, docs, holder, fresh) bucketed and sorted by key in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int, fan: int = 4):
        self.spark, self.buckets, self.fan = spark, buckets, fan
        self.levels: list[list[str]] = [[]]
        self.names: list[str] = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (df.repartition(self.buckets, "h", "c").write.bucketBy(self.buckets, "h", "c").sortBy("h", "c")
         .option("path", common.scratch(self.spark, "line-run")).saveAsTable(name))
        self.names.append(name)
        return name

    def rows(self) -> DataFrame | None:
        """All runs merged: one row per key."""
        names = [n for level in self.levels for n in level]
        return self._merged(names) if names else None

    def _merged(self, names: list[str]) -> DataFrame:
        """Merge runs pairwise on their sort order. A key is fresh in one run at most; that run names its holder."""
        out = self.spark.table(names[0]).select("h", "c", "docs", "holder", "fresh")
        for name in names[1:]:
            other = self.spark.table(name).select("h", "c", F.col("docs").alias("docs_"), F.col("holder").alias("holder_"),
                                                  F.col("fresh").alias("fresh_"))
            fresh, fresh_ = F.coalesce("fresh", F.lit(False)), F.coalesce("fresh_", F.lit(False))
            out = out.join(other, ["h", "c"], "full").select(
                "h", "c", (F.coalesce("docs", F.lit(0)) + F.coalesce("docs_", F.lit(0))).alias("docs"),
                F.when(fresh, F.col("holder")).when(fresh_, F.col("holder_")).alias("holder"), (fresh | fresh_).alias("fresh"))
        return out

    def add(self, lines: DataFrame) -> None:
        """Anti-join one batch with the runs, then add it as a run and compact full levels."""
        own = lines.groupBy("h", "c").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("holder"))
        names = [n for level in self.levels for n in level]
        if names:
            own = common.staged(own, "line-batch")
            fresh = own
            for name in names:
                fresh = fresh.join(self.spark.table(name).select("h", "c"), ["h", "c"], "left_anti")
            new = fresh.select("h", "c", F.lit(True).alias("fresh"))
            own = own.join(new, ["h", "c"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
        else:
            own = own.withColumn("fresh", F.lit(True))
        self.levels[0].append(self._write(own))
        level = 0
        while len(self.levels[level]) >= self.fan:
            whole = self._write(self._merged(self.levels[level]))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(whole)
            self.levels[level] = []
            level += 1

    def close(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def batch_bounds(lines: DataFrame, batches: int) -> list[int]:
    """Ascending doc_id cuts; any cuts give the same result, these balance the batches."""
    cuts = lines.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    return sorted(set(cuts or []))


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = 5,
               fan: int = 4) -> DataFrame:
    """``docs`` with text replaced by its kept lines, plus n_lines and n_dropped."""
    spark = docs.sparkSession
    # rows without doc_id have nothing to deal them out by but their text
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    lines = common.staged(long_lines(docs.select("doc_id", "text", salt.alias("salt")), least_chars), "lines")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = LineRuns(spark, buckets, fan)
    try:
        cuts = batch_bounds(lines, batches)
        edges = [None, *cuts, None]
        for low, high in reversed(list(zip(edges[:-1], edges[1:]))):
            part = lines
            if low is not None:
                part = part.filter(F.col("doc_id") > low)
            if high is not None:
                part = part.filter(F.col("doc_id") <= high)
            if low is None:
                part = part.unionByName(lines.filter(F.col("doc_id").isNull())) if high is not None else lines
            runs.add(part)
        found = common.staged(runs.rows().filter(F.col("docs") >= least_docs), "repeated-lines")
    finally:
        runs.close()
    total = found.agg(F.sum("docs")).first()[0] or 0
    hot_docs = max(1, total // HOT_KEYS + 1)
    hot = F.broadcast(found.filter(F.col("docs") >= hot_docs).select("h", "c", "holder", F.lit(True).alias("hot")))
    cold = found.filter(F.col("docs") < hot_docs).select("h", "c", F.col("holder").alias("cold_holder"))
    tried = lines.join(hot, ["h", "c"], "left")
    lost = tried.filter(F.col("hot") & ~F.col("doc_id").eqNullSafe(F.col("holder"))).select("doc_id", "salt", "h", "c")
    rest = tried.filter(F.col("hot").isNull()).select("doc_id", "salt", "h", "c").join(cold, ["h", "c"])
    lost = lost.unionByName(rest.filter(~F.col("doc_id").eqNullSafe(F.col("cold_holder"))).select("doc_id", "salt", "h", "c"))
    lost = lost.groupBy(F.col("doc_id").alias("_id"), F.col("salt").alias("_salt")).agg(
        F.collect_set(F.struct("h", "c")).alias("_lost"))
    out = docs.withColumn("_docsalt", salt)
    out = out.join(lost, out["doc_id"].eqNullSafe(lost["_id"]) & (out["_docsalt"] == lost["_salt"]), "left")
    # a text's lost keys in about as many groups as the root of their number: a line looks through one group only
    groups = F.least(F.lit(4096), F.floor(F.sqrt(F.size("_lost"))).cast("int"))
    out = out.withColumn("_lost", F.when(F.col("_lost").isNotNull(), F.transform(
        F.sequence(F.lit(0), groups - 1), lambda i: F.filter("_lost", lambda k: F.pmod(k["h"], groups) == i))))
    is_lost = lambda k: F.array_contains(F.get("_lost", F.pmod(k["h"], F.size("_lost")).cast("int")), k)
    split = F.split(common.text_of(), "\n")
    pairs = F.transform(split, lambda x: F.struct(x.alias("line"), F.when(F.char_length(x) >= least_chars, line_key(x)).alias("key")))
    kept = F.transform(F.filter(pairs, lambda p: p["key"].isNull() | (F.char_length(p["key"]) < least_chars)
                                | ~is_lost(key_hash(p["key"]))), lambda p: p["line"])
    out = out.withColumn("_lines", F.when(F.col("_lost").isNotNull(), kept))
    n_lines = F.char_length(common.text_of()) - F.char_length(F.replace(common.text_of(), F.lit("\n"), F.lit(""))) + 1
    n_kept = F.coalesce(F.size(F.col("_lines")), F.lit(0))
    n_dropped = F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(n_lines - n_kept)
    text = F.when(F.col("_lost").isNull(), F.col("text")).otherwise(F.array_join("_lines", "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[text.alias(c) if c == "text" else out[c] for c in names],
                      n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in three or more documents stay in the largest doc_id alone."""
    out = drop_lines(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.encode(common.text_of(), "utf-8"), 256).alias("kept_sha256"))
