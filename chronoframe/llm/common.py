"""What the corpus operators share: reading tables, tables in the shared folder, text columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for tables between jobs. Only a session in one process, as in tests, may go without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='chronoframe-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that materialize() wrote and nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_table_path", None):
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def give_back() -> None:
    """Hand memory that a task no longer needs back to the system: its Python worker lives on through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def with_text_id(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with a BIGINT that equal texts share and different texts do not. Should two texts share 64 bits of a hash, other bits tell them apart."""
    plain, check = F.xxhash64(text_col), F.xxhash64(F.lit("check"), text_col)
    clashes = df.groupBy(plain.alias("_id")).agg(F.min(check).alias("_a"), F.max(check).alias("_b")).where("_a != _b").select("_id", "_a")
    clashes = materialize(clashes, "clashes")
    if clashes.isEmpty():
        discard(clashes)
        return df.withColumn(name, plain)
    joined = df.join(clashes, plain == clashes["_id"], "left")
    return joined.withColumn(name, F.when(F.col("_a") != check, F.xxhash64(F.lit("other"), check)).otherwise(plain)).drop("_id", "_a")
