"""Session helpers: tables by path, the shared checkpoint folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a small join side may be sent to every executor, and rows up to which it is measured at all.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of spark.checkpoint.dir, or of the checkpoints set before.

    Only a local master, as in tests, gets a folder of its own where none is named; on a cluster that is an error, as a folder
    on one machine can't be read from another.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sonargrid-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that it outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _row_bytes(df: DataFrame) -> Column:
    """A bound of the bytes of a row: arrays and texts by their length, all else by 16."""
    parts: Column = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("array", "map"):
            parts = parts + 64 * F.coalesce(F.greatest(F.size(f.name), F.lit(0)), F.lit(0))
        elif kind in ("string", "binary"):
            parts = parts + F.coalesce(F.octet_length(f.name), F.lit(0))
    return parts


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether there are at most ``rows`` rows of together at most ``size`` bytes. Looks at no more than ``rows`` + 1 rows."""
    n, total = df.select(_row_bytes(df).alias("b")).limit(rows + 1).agg(F.count("*"), F.sum("b")).first()
    return n <= rows and (total or 0) <= size


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a side that is expected to be small: it is broadcast only if its rows and bytes are within bounds, else shuffled.

    ``small`` is evaluated once more than needed to measure it up to the bound, so it should be cheap or a checkpoint.
    """
    return big.join(F.broadcast(small) if is_small(small, rows) else small.hint("shuffle_merge"), on, how)
