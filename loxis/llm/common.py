"""What the text operators share: reading tables, staged tables, packed binary columns."""

from __future__ import annotations

import pickle
import struct
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one if that is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loxis-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: What this process has staged and not yet cleared: paths, and names of tables with their paths.
_MADE: list[tuple[str | None, str]] = []


def staged(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: later stages start from committed files, whatever executor is lost.

    by: a column of few values, each written to a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _MADE.append((None, path))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """As staged, as a table in buckets by key: a later grouping by key doesn't shuffle it again."""
    return sorted_table(df, label, key, None)[0]


def sorted_table(df: DataFrame, label: str, key: str, order: str | None) -> tuple[DataFrame, str, int]:
    """Write df as a table in buckets by key, each sorted by order; the table, its folder and the number of buckets."""
    spark = df.sparkSession
    name, buckets = f"loxis_{label}_{uuid.uuid4().hex}", width(spark)
    path = f"{shared_dir(spark)}/{name}"
    writer = df.write.bucketBy(buckets, key)
    writer = (writer.sortBy(order) if order else writer).option("compression", "zstd").option("path", path)
    writer.saveAsTable(name, format="parquet")
    _MADE.append((name, path))
    return spark.table(name), path, buckets


def clear(spark: SparkSession) -> int:
    """Delete what the operators have staged in this process, once their results are written; the number of folders."""
    files = spark._jvm.org.apache.hadoop.fs
    done = 0
    while _MADE:
        name, path = _MADE.pop()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = files.Path(path)
        done += at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return done


def free_name(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle: grows with the cluster's own setting, not with a constant here."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(value) -> bytes:
    """Pickle and compress a small structure of arrays."""
    raw = pickle.dumps(value, 5)
    return struct.pack("<q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes):
    return pickle.loads(pa.decompress(data[8:], struct.unpack("<q", data[:8])[0], "zstd", asbytes=True))


def crc_text(column: str):
    """crc32 of the decimal text of an id; of the empty text where the id is null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
