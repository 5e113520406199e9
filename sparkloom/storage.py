"""Tables written on the way: they cut the lineage and hold what must not be computed twice."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where spark.checkpoint.dir is unset and all runs on one machine, as in tests.
DEFAULT_DIR = "/tmp/checkpoints/sparkloom"
#: Bytes of a broadcast side at most, as `small_side` estimates them.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. On a cluster spark.checkpoint.dir must name it:
    a folder of each machine's own would lose rows."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
    return DEFAULT_DIR


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder for a table of one's own. What is there goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    target, system = _path(spark, path)
    system.deleteOnExit(target)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors,
    keeps column pruning. The files go when the session's JVM ends, or with `discard`."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkloom_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that `materialise` returned, once no plan that is still to run reads them."""
    for df in tables:
        path = getattr(df, "_sparkloom_path", None)
        if path:
            target, system = _path(df.sparkSession, path)
            system.delete(target, True)
            df._sparkloom_path = None


def _bytes_of(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes; 8 for a null."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 8
    elif isinstance(kind, T.ArrayType):
        fixed = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
        size = F.size(value) * 8 + 16 if fixed else F.aggregate(value, F.lit(16), lambda acc, x: (acc + _bytes_of(x, kind.elementType)).cast("int"))
    elif isinstance(kind, T.MapType):
        size = _bytes_of(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes_of(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = F.lit(8)
        for f in kind.fields:
            size = size + _bytes_of(value[f.name], f.dataType)
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(8))


def fits(df: DataFrame, most: int, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows, and takes at most about so many bytes. df must be cheap to read; at
    most `most` rows and one are."""
    size = F.lit(16)
    for f in df.schema.fields:
        size = size + _bytes_of(F.col(f"`{f.name}`"), f.dataType)
    n, total = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return n <= most and (total or 0) <= most_bytes


def small_side(df: DataFrame, most: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it fits these limits, else df as it is (then the join shuffles, and adaptive
    execution splits skewed keys). df must be cheap to read."""
    return F.broadcast(df) if fits(df, most, most_bytes) else df
