"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than space, tab, line feed,
vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"
#: Java and Python regular expression of the gap between two words.
GAP = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master, as in tests, may leave it unset: a temporary folder is
    then used. On a cluster executors would write to disks of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="chronolink-"))
    return _own_dir[0]


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again.

    Cuts the lineage: what follows survives a lost executor by rereading the
    table, and nothing upstream is computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*stored: DataFrame) -> None:
    """Deletes tables that store() wrote and that nothing reads any more."""
    for df in stored:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal id, modulo modulus."""
    return F.crc32(doc_id.cast("string")) % modulus
