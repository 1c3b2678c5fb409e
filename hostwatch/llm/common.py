"""Shared helpers: scratch tables, text measures, prefix sums over chunk counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ASCII white space that separates words.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Most bytes in a batch that Spark hands to a Python worker; long documents would else fill one of 64 MB several times over.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = "".join(c for c in spark.conf.get(key) if c.isdigit())
    if int(now or 0) > BATCH_BYTES or not int(now or 0):
        spark.conf.set(key, str(BATCH_BYTES))


def release_memory() -> None:
    """Give what a Python worker no longer uses back to the system: workers stay for tasks of later stages."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:                 # a C library without it
        pass


def releasing(function):
    """``function`` over batches, after whose last batch memory is given back."""
    def run(batches):
        yield from function(batches)
        release_memory()
    return run


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (tests), a folder in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, never used before."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from a scan that any executor can repeat."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def div(value: Column, by: int) -> Column:
    """Whole-number division, exact beyond 2^53."""
    return F.call_function("div", value.cast("long"), F.lit(by).cast("long"))


def replace_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; an input column of the same name gives way."""
    return df.select(*[df[c] for c in df.columns if c not in columns], *[v.alias(k) for k, v in columns.items()])


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Stage a narrow table and broadcast it only if its counted rows are within ``rows``; else joins shuffle."""
    table = staged(df, "small")
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def before(counts: DataFrame, keys: list[str], chunk: str, value: str, name: str, fan: int = 1024) -> DataFrame:
    """Add the sum of ``value`` over the smaller chunks of the same keys, in two levels of at most ``fan`` chunks.

    ``counts`` has one row per (keys, chunk); a task holds the chunks of one block, then one row per block.
    """
    counts = counts.withColumn("_block", div(F.col(chunk), fan))
    inner = Window.partitionBy(*keys, "_block").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum")).select(
        *keys, "_block", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_base"))
    zero = F.lit(0).cast(counts.schema[value].dataType)
    out = counts.withColumn("_in", F.coalesce(F.sum(value).over(inner), zero)).join(blocks, [*keys, "_block"])
    return out.withColumn(name, F.col("_in") + F.col("_base")).drop("_block", "_in", "_base")


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, values: list[str], cuts: int = 4096) -> DataFrame:
    """Join every row with its key's row of ``table`` (one per key, with the key's number of rows).

    Keys with more than 1/``cuts`` of all rows, at most ``cuts`` of them, are joined by broadcast, the others by shuffle.
    """
    limit = max(2, total // cuts + 1)
    hot = F.broadcast(table.filter(F.col(count) >= limit).select(
        key, F.lit(True).alias("hot_"), *[F.col(v).alias(f"hot_{v}") for v in values]))
    cold = table.filter(F.col(count) < limit).select(key, *values)
    tried = rows.join(hot, key, "left")
    done = tried.filter("hot_").select(*rows.columns, *[F.col(f"hot_{v}").alias(v) for v in values])
    rest = tried.filter(F.col("hot_").isNull()).select(*rows.columns).join(cold, key).select(*rows.columns, *values)
    return done.unionByName(rest)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, label for every node of ``links``: the least node that links reach. Written each round to cut lineage.

    Every round takes the least label among the neighbours and then the label of that label; rounds go on until
    nothing changes, however long a chain is.
    """
    edges = staged(links.select(F.col(a).alias("v"), F.col(b).alias("u")).unionByName(
        links.select(F.col(b).alias("v"), F.col(a).alias("u"))).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("near")).select(
        "node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("u"), F.col("label").alias("other")), "u").groupBy(
            F.col("v").alias("node")).agg(F.min("other").alias("other"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "other").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jumped"))
        step = staged(step.join(jump, "low").select("node", F.col("label").alias("old"), F.least("low", "jumped").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter("old != label").limit(1).count() == 0:
            return labels
