"""Helpers shared by the corpus operators: table access, scratch tables and bounded Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every internal column, so that no column of a caller's table clashes with one of ours.
P = "_mx_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where the session names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        configured = f"{warehouse.rstrip('/')}/_scratch"
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def drop_scratch(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone, and the table with it
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            drop_scratch(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: it outlives executors, and its size is known.

    ``release`` frees it after its last use; what is left goes when the driver ends. A driver that is killed leaves tables
    named scratch-* in the folder, which may be deleted once no job runs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    atexit.register(_drop_at_exit, spark, path)
    return out


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        drop_scratch(df.sparkSession, df.scratch_path)


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4_194_304}


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes as well as in rows; documents differ in length by a factor of 10,000.

    Plans read these settings when they run, so they stay set in the session; lower settings of the caller are kept.
    """
    for key, most in BATCH.items():
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n; null where the id is null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def unit_hash(*parts):
    """A number in [0, 1) from the md5 of the parts joined by ':', 52 bits wide; the same in every SQL dialect."""
    key = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


BROADCAST_ROWS, SALTS = 100_000, 64
#: A key is hot from HOT_ROWS rows on, and only with more than a HOT_KEYS-th of all rows: so there are fewer than HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1_000, 20_000


def hot_keys(sizes: DataFrame, n: str, rows: int) -> DataFrame | None:
    """The keys of ``sizes`` (one row a key) whose number of rows ``n`` is hot among ``rows`` rows; None if there are none.

    They are fewer than HOT_KEYS whatever the input: they pass through the driver, and may be broadcast.
    """
    found = sizes.where(F.col(n) > max(HOT_ROWS, rows // HOT_KEYS)).drop(n)
    hot = found.collect()  # fewer than HOT_KEYS rows of a key
    return sizes.sparkSession.createDataFrame(hot, found.schema) if hot else None


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join with ``right``, which has one row a key: rows of ``hot`` keys never move, the rest is shuffled by key."""
    if hot is None:
        return left.join(right, keys)
    few = F.broadcast(hot.select(*keys))  # fewer than HOT_KEYS rows
    rest = left.join(few, keys, "left_anti").join(right, keys)
    return rest.unionByName(left.join(F.broadcast(right.join(few, keys, "left_semi")), keys))


def join_keyed(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``left`` with ``right``, which has one row a key, on ``left[key] <=> right[key]``, whatever the skew of left.

    ``right`` is counted first: up to BROADCAST_ROWS rows it is broadcast; beyond, rows of left are dealt over SALTS
    salts and the right side is repeated for each, so that no key meets in one task.
    """
    names = [c for c in right.columns if c != key]
    right = materialize(right)
    if right.count() <= BROADCAST_ROWS:
        side = F.broadcast(right.withColumnRenamed(key, P + "rk"))
        return left.join(side, F.col(key).eqNullSafe(F.col(P + "rk")), how).drop(P + "rk")
    many = right.withColumnRenamed(key, P + "rk").withColumn(P + "rs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = left.withColumn(P + "ls", F.pmod(F.xxhash64(*[c for c, t in left.dtypes if t in ("bigint", "int", "string")]), F.lit(SALTS)).cast("int"))
    on = F.col(key).eqNullSafe(F.col(P + "rk")) & (F.col(P + "ls") == F.col(P + "rs"))
    return dealt.join(many, on, how).select(*left.columns, *names)
