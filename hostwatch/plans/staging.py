"""Tables written once per application so that later plans start from a scan.

A written table cuts lineage in a way that survives executor loss. It lives under
the folder the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

_written: set[tuple[str, str]] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else a folder in its warehouse: both are shared on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/staged-tables"


def input_fingerprint(spark: SparkSession, folder: str) -> str:
    """Digest of names, sizes and times of the files below an input folder: changed input gives other staged tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def table_path(spark: SparkSession, name: str) -> str:
    digest = hashlib.sha256(name.encode()).hexdigest()[:16]
    return f"{shared_folder(spark)}/staged/{spark.sparkContext.applicationId}/{digest}"


def staged_path(spark: SparkSession, name: str, write) -> str:
    """Folder ``name``; the first use in an application fills it with ``write(path)``."""
    path = table_path(spark, name)
    token = (spark.sparkContext.applicationId, path)
    if token not in _written:
        write(path)
        _written.add(token)
    return path


def staged(spark: SparkSession, name: str, build) -> DataFrame:
    """The staged parquet table ``name``, built on first use."""
    return spark.read.parquet(
        staged_path(spark, name, lambda path: build().write.mode("overwrite").parquet(path)))
