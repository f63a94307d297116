"""Helpers shared by operators: tables, bounded lookups, lineage cuts, name clashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup table with more rows than this is joined by shuffle or refused, never broadcast or closed over.
LOOKUP_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup_rows(df: DataFrame, limit: int = LOOKUP_ROWS) -> list:
    """The rows of a lookup table, refused beyond `limit` so that no growing table reaches the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"lookup table has more than {limit} rows")
    return rows


def bounded_broadcast(df: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """A broadcast hint if the table is within `limit` rows; otherwise the table as it is, left to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='talkmill-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of `df` written to the shared checkpoint folder and read back: later jobs start from the files."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` as a parquet table in the shared folder; smaller and re-readable by column, so preferred for wide rows."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of `written` that no later job reads. Only what `written` itself returned is removed."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores, for Python work on tables of one or a few small files.

    Scans of larger tables have more partitions than cores and stay as they are.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def norm_id(c: Column | str) -> Column:
    """Conversation ids that differ only in case or outer blanks are one: trimmed, upper case; blank is null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.upper(trimmed(c))
    return F.when(t != "", t)


def trimmed(c: Column | str) -> Column:
    """Without outer white space of any kind (Spark's trim takes blanks only)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$", "")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent
    held = tempfile.mkdtemp(prefix="talkmill-code-")
    shutil.copytree(root, f"{held}/tree/{root.name}", ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    sc.addPyFile(shutil.make_archive(f"{held}/{root.name}", "zip", f"{held}/tree"))
    _SHIPPED.add(sc.applicationId)


#: A join key with more rows than this is joined apart, by broadcast of its few facts (at most rows / HOT_ROWS of them).
HOT_ROWS = 200_000


def join_hot(big: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of `big` with one fact per key, where `facts` also has the number of rows of `big` with that key.

    Keys over HOT_ROWS are so few that their facts are broadcast; the others are joined by shuffle.
    """
    hot = facts.filter(F.col(count) > HOT_ROWS).drop(count)
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.filter(F.col(count) <= HOT_ROWS).drop(count), key)
    return rest.unionByName(big.join(F.broadcast(hot), key))


def running(df: DataFrame, group: str, order: list[str], weight: Column, name: str) -> DataFrame:
    """`df` with the sum of `weight` over the rows of the group before each row, without bringing a group into one task.

    Rows are range-partitioned by group and order; sums within a partition are added to those of the group in earlier
    partitions, of which there are no more than partitions. `order` should be unique within a group.
    """
    from pyspark.sql import Window as W

    laid = written(df.withColumn("_run_w", weight).repartitionByRange(group, *order).withColumn("_run_part", F.spark_partition_id()))
    past = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sums = laid.groupBy(group, "_run_part").agg(F.sum("_run_w").alias("_run_n"))
    offsets = sums.select(group, "_run_part", F.coalesce(F.sum("_run_n").over(past(W.partitionBy(group).orderBy("_run_part"))), F.lit(0)).alias("_run_before"))
    local = laid.withColumn("_run_local", F.coalesce(F.sum("_run_w").over(past(W.partitionBy(group, "_run_part").orderBy(*order))), F.lit(0)))
    return local.join(offsets, [group, "_run_part"]).withColumn(name, F.col("_run_before") + F.col("_run_local")).drop("_run_part", "_run_before", "_run_local", "_run_w")


def with_earlier(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """`df` range-partitioned by group and order, with `_part`, and in each part the k rows of the group before it, marked by `_ghost`.

    A window over (group, _part) in this order then sees for every row what one over the group would, up to k rows back, and no
    group is brought into one task. `order` should be unique within a group. Drop the ghosts afterwards.
    """
    from pyspark.sql import Window as W

    laid = written(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    last = laid.withColumn("_k", F.row_number().over(W.partitionBy(group, "_part").orderBy(*[F.desc(c) for c in order]))).filter(F.col("_k") <= k)
    parts = laid.filter(F.col(group).isNotNull()).select(F.col(group).alias("_of"), F.col("_part").alias("_to")).distinct()  # no more than partitions for a group
    near = last.join(parts, (F.col(group) == F.col("_of")) & (F.col("_to") > F.col("_part")))
    near = near.withColumn("_r", F.row_number().over(W.partitionBy(group, "_to").orderBy(F.desc("_part"), "_k"))).filter(F.col("_r") <= k)
    ghosts = near.select(*df.columns, F.col("_to").alias("_part"), F.lit(True).alias("_ghost"))
    return laid.withColumn("_ghost", F.lit(False)).unionByName(ghosts)


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """`df` with the place of each row within its group, from 0."""
    return running(df, group, order, F.lit(1), name)
