"""What the operators share: the folder all executors see, tables written there, a distributed rank."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@functools.cache
def local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="larder-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which the driver and all executors see.

    A session in one process may leave it unset; then a temporary folder is used. On a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = local_dir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(table: DataFrame, rows: int = 1_000_000, size: int = 64 << 20) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``rows`` rows of ``size`` bytes (as text) in all.

    Beyond that Spark chooses the join by its own statistics. Both give the same rows.
    """
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in table.columns), F.lit(0))
    n, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(table) if n <= rows and total <= size else table


def with_unique(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot: int = 1_000_000) -> DataFrame:
    """``rows`` joined on ``key`` with a written table that has each key once, however many rows share a key.

    A small table is broadcast, else the join is ``salted``.
    """
    small = broadcast_if_small(table)
    return salted(rows, table, key, how, hot) if small is table else rows.join(small, key, how)


def salted(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot: int = 1_000_000) -> DataFrame:
    """The same by a shuffle join, for a table that need not be written.

    The rows of a key with more than ``hot`` rows are dealt out over salts, and the table's row of that key is copied for
    each; there is at most one such key for each ``hot`` rows.
    """
    crowded = saved(rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > hot).select(key, F.ceil(F.col("count") / hot).alias("_salts")), "crowded")
    if crowded.isEmpty():
        return rows.join(table, key, how)
    crowded, salts = broadcast_if_small(crowded), F.coalesce("_salts", F.lit(1))
    dealt = rows.join(crowded, key, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts)).drop("_salts")
    copies = table.join(crowded, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with its 0-based place in the total order, without gathering the rows in one task.

    Rows are range-partitioned and sorted; the count of each partition (one number a partition) gives its offset.
    Rows that are equal in ``order`` get different ranks in an arbitrary order.
    """
    spark = df.sparkSession
    marked = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    rows = saved(marked, "ranked")
    part, at = F.shiftrightunsigned("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    offset, offsets = 0, []
    for p, n in rows.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((p, offset))
        offset += n
    table = spark.createDataFrame(offsets or [(0, 0)], "_part long, _offset long")
    return rows.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(name, F.col("_offset") + at).drop("_mid", "_part", "_offset")
