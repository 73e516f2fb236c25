"""Small building blocks used by every operator."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: the one the cluster names, else a fresh one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_DIRS[context.applicationId]


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The plan restarts at a columnar scan, so iterations do not grow the lineage, a lost executor re-reads
    files instead of recomputing, and the file sizes feed the size-checked broadcast decision.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many partitions as there are cores, if it comes in fewer, as a table of one small file does. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cols(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def top_n(df: DataFrame, keys, order: list, n: int, rank: str | None = None) -> DataFrame:
    """First `n` rows per key. The rank filter sits on the window, so Spark trims each group before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*cols(keys)).orderBy(*order))).filter(
        F.col(name) <= n
    )
    return out if rank else out.drop(name)


def first_row(df: DataFrame, keys, order: list) -> DataFrame:
    """The first row per key."""
    return top_n(df, keys, order, 1)


def ordered_list(df: DataFrame, keys, order: list, value: Column, n: int, name: str) -> DataFrame:
    """Array of the first `n` values per key in the given order; lists never exceed `n` entries."""
    ranked = top_n(df.withColumn("_value", value), keys, order, n, "_pos")
    return ranked.groupBy(*cols(keys)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_value"))), lambda s: s["_value"]).alias(name)
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def min_row(fields: list) -> Column:
    """Aggregate that picks the struct with the smallest leading fields; combines on the map side."""
    return F.min(F.struct(*fields))


def edge_id(rel, src: Column, dst: Column, source_id: Column) -> Column:
    """Stable edge id, unchanged by a rebuild."""
    rel_col = F.lit(rel) if isinstance(rel, str) else rel
    return F.sha2(F.concat_ws("|", rel_col, src, dst, source_id), 256)


def joined(array_col: Column, sep: str = "|") -> Column:
    return F.array_join(F.array_sort(array_col), sep)
