"""Defect-tolerant flow-meter CSV reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FLOW_COLUMNS, NUMERIC_ADOPTION_RATIO
from ..functions.columns import epoch_us
from ..functions.times import parse_timestamp

# Texts that count as an empty cell.
EMPTY_TEXTS = ("", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Texts that are surely a number, and texts that surely are none (a letter or sign that no number has, or two dots).
NUMBER = r"^[+-]?[0-9]{1,300}(\.[0-9]{1,300})?$"
NO_NUMBER = r"[^\x00-\x20\x7F-\uFFFF0-9+\-.a-fA-FxXpPiInNtTyY]|\..*\."


def _cell(raw: Column) -> Column:
    text = F.trim(raw)
    return F.when(text.isin(list(EMPTY_TEXTS)), F.lit(None)).otherwise(text)


def is_number(text: Column) -> Column:
    """True where the cast to double gives a number or an infinity, else false.

    A failed cast costs an exception, so it is tried only on texts whose characters leave it open.
    """
    value = text.try_cast("double")
    return F.when(text.isNull(), False).when(text.rlike(NUMBER), True).when(text.rlike(NO_NUMBER), False).otherwise(
        value.isNotNull() & ~F.isnan(value))


def read_flow_csv(spark: SparkSession, path: str, label: str = FLOW_COLUMNS["label"],
                  adoption_ratio: float = NUMERIC_ADOPTION_RATIO) -> DataFrame:
    """Strip header names, drop repeated header rows, adopt numeric columns, infinities to NULL.

    One aggregate over the file decides which columns are numeric (a row per column). It goes over the cells as rows of a
    (column, cell): an expression for each of many columns makes a method that the JVM does not compile.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"')
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    if label not in raw.columns:
        raise ValueError(f"{path} has no {label!r} column after header cleanup")
    rows = raw.filter(F.coalesce(F.trim(F.col(f"`{label}`")), F.lit("")) != label)
    cells = rows.select(*[_cell(F.col(f"`{c}`")).alias(c) for c in rows.columns])
    each = rows.select(F.posexplode(F.array(*[F.col(f"`{c}`") for c in rows.columns])).alias("at", "raw"))
    each = each.select("at", _cell(F.col("raw")).alias("cell"))
    counts = each.groupBy("at").agg(F.try_divide(F.count_if(is_number(F.col("cell"))), F.count("cell")).alias("ratio")).collect()
    ratios = {c: None for c in rows.columns} | {rows.columns[r["at"]]: r["ratio"] for r in counts}
    parsed = lambda c: F.col(f"`{c}`").try_cast("double")
    finite = lambda c: F.when(F.abs(parsed(c)) < float("inf"), parsed(c))
    return cells.select(*[
        (finite(c) if ratios[c] is not None and ratios[c] >= adoption_ratio else F.col(f"`{c}`")).alias(c)
        for c in cells.columns])


def to_canonical(df: DataFrame, mapping: dict = FLOW_COLUMNS, ordered: bool = False) -> DataFrame:
    """Mapped columns under canonical names, timestamps parsed; missing columns raise.

    ``ordered`` adds a global time sort, only needed for a sorted file.
    """
    missing = [raw for raw in mapping.values() if raw not in df.columns]
    if missing:
        raise ValueError(f"input lacks mapped column(s) {missing}")
    out = df.select(*[F.col(f"`{raw}`").alias(name) for name, raw in mapping.items()])
    out = out.withColumn("timestamp", parse_timestamp("timestamp"))
    out = out.withColumn("start_us", epoch_us("timestamp"))
    return out.orderBy("start_us") if ordered else out


def numeric_columns(mapping: dict = FLOW_COLUMNS) -> list[str]:
    return [c for c in mapping if c not in ("timestamp", "src_ip", "dst_ip", "label")]
