"""Exact dedup as a stateful stream.

A stream of fingerprint rows is grouped by digest in a RocksDB state store on disk, without watermark and so without
expiry. For each digest the state retains the row that stays: most code points, then smallest doc_id (the stable
identifier), with the content locator (file and row), and the number of rows seen. A restarted or extended stream
continues from its checkpoint in the shared folder. After the input is used up the state is read back as a table.

Hits are checked on full bytes: the rows of every digest seen more than once are read again and the least and the
greatest normalised text of the digest must be equal. Rows of a digest for which they differ are grouped by the bytes
themselves, so a collision of the digest never merges texts (tests use a weak digest).

Copies are combined before each shuffle, so a digest with a third of all rows is one row per task; digests that are
that frequent are joined by broadcast, at most 4096 of them. Null text is empty; null doc_id comes after all others;
equal rows are told apart by their locator. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOT_DIGESTS = 4096


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    for space in common.SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "utf-8"), 256))


def preference(n_chars: Column, doc_id: Column, locator: Column) -> Column:
    """The greatest of these stays."""
    return F.struct(n_chars.alias("n_chars"), (-doc_id).alias("minus_id"), locator.alias("locator"))


def keyed_state(stream: DataFrame) -> DataFrame:
    """The stateful part: digest -> (group_size, keep). Works on a stream or a table of fingerprint rows."""
    return stream.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(preference(F.col("n_chars"), F.col("doc_id"), F.col("locator"))).alias("keep"))


#: Settings of the stateful query: state on disk, each store closed when its task has committed.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.unloadOnCommit": "true"}


def run_stream(stream: DataFrame, checkpoint: str) -> None:
    """Run the stateful dedup over all input that is there now; state stays in ``checkpoint``."""
    conf = stream.sparkSession.conf
    old = {k: conf.get(k, None) for k in STATE_CONF}
    for key, value in STATE_CONF.items():
        conf.set(key, value)
    try:
        query = (keyed_state(stream).writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for key, value in old.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)


def state_table(spark, checkpoint: str) -> DataFrame:
    """digest, group_size, keep as the stream last committed them."""
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.fieldNames()
    return state.select(F.col("key").getField("digest").alias("digest"), F.col("value").getField(value[0]).alias("group_size"),
                        F.col("value").getField(value[1]).alias("keep"))


def fingerprints(docs: DataFrame, locator: Column, digest=sha256) -> DataFrame:
    text = common.text_of()
    return docs.select("doc_id", F.char_length(text).cast("long").alias("n_chars"),
                       digest(normalised(text)).alias("digest"), locator.alias("locator"))


def file_locator() -> Column:
    """File and row of a table read from Parquet."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def colliding_digests(docs: DataFrame, hits: DataFrame, digest) -> DataFrame:
    """Digests whose texts are not all the same bytes. ``hits`` has doc_id of rows in groups of two and more."""
    ids = hits.select(F.col("doc_id").alias("_id"))
    ids = ids.distinct()
    ids = common.small(ids)
    texts = docs.select("doc_id", normalised(common.text_of()).alias("bytes"))
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    return texts.groupBy(digest(F.col("bytes")).alias("digest")).agg(
        F.min("bytes").alias("least"), F.max("bytes").alias("greatest")).filter("least != greatest").select("digest")


def with_groups(rows: DataFrame, groups: DataFrame, key: str, rows_in_all: int) -> DataFrame:
    """Join every row with its group; frequent keys (at most 4096 can be) by broadcast, the others by shuffle."""
    limit = max(2, rows_in_all // HOT_DIGESTS + 1)
    columns = [groups["group_size"], groups["keep"]]
    hot = F.broadcast(groups.filter(F.col("group_size") >= limit).select(key, *[c.alias(f"hot_{n}") for c, n in zip(columns, ("size", "keep"))]))
    cold = groups.filter(F.col("group_size") < limit)
    tried = rows.join(hot, key, "left")
    done = tried.filter(F.col("hot_size").isNotNull()).select(*rows.columns, F.col("hot_size").alias("group_size"),
                                                               F.col("hot_keep").alias("keep"))
    return done.unionByName(tried.filter(F.col("hot_size").isNull()).select(*rows.columns).join(cold, key)
                            .select(*rows.columns, "group_size", "keep"))


def deduplicate(docs: DataFrame, locator: Column | None = None, digest=sha256, batch_bytes: int = 1 << 30) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, digest, locator, group_size, keep_id, kept.

    ``batch_bytes`` bounds a micro-batch. The default locator needs a table read from files.
    """
    spark = docs.sparkSession
    prints = fingerprints(docs, locator if locator is not None else file_locator(), digest)
    path = common.scratch(spark, "fingerprints")
    prints.write.parquet(path)
    rows = spark.read.schema(prints.schema).parquet(path)
    checkpoint = common.scratch(spark, "dedup-state")
    run_stream(spark.readStream.schema(prints.schema).option("maxBytesPerTrigger", batch_bytes).parquet(path), checkpoint)
    groups = common.staged(state_table(spark, checkpoint), "dedup-groups")
    total = rows.count()
    joined = with_groups(rows, groups, "digest", total)
    result = joined.select("doc_id", "n_chars", "digest", "locator", "group_size",
                           (-F.col("keep.minus_id")).alias("keep_id"), (F.col("locator") == F.col("keep.locator")).alias("kept"))
    result = common.staged(result, "dedup-result")
    mixed = common.staged(colliding_digests(docs, result.filter("group_size > 1"), digest), "dedup-collisions")
    if mixed.limit(1).count() == 0:
        return result
    return result.join(mixed, "digest", "left_anti").unionByName(
        by_bytes(docs, locator if locator is not None else file_locator(), digest, mixed))


def by_bytes(docs: DataFrame, locator: Column, digest, mixed: DataFrame) -> DataFrame:
    """Rows of colliding digests, grouped by the normalised text itself."""
    text = common.text_of()
    rows = docs.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), digest(normalised(text)).alias("digest"),
                       locator.alias("locator"), normalised(text).alias("bytes")).join(mixed, "digest", "left_semi")
    groups = rows.groupBy("bytes").agg(F.count(F.lit(1)).alias("group_size"),
                                       F.max(preference(F.col("n_chars"), F.col("doc_id"), F.col("locator"))).alias("keep"))
    return rows.join(groups, "bytes").select(
        "doc_id", "n_chars", "digest", "locator", "group_size", (-F.col("keep.minus_id")).alias("keep_id"),
        (F.col("locator") == F.col("keep.locator")).alias("kept"))


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents; equal when identical without ASCII white space."""
    out = deduplicate(common.documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
