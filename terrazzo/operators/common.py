"""Pieces that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_in(df: DataFrame, keys: list[str], order: list, keep: int = 1, name: str | None = None) -> DataFrame:
    """The first `keep` rows of each group by a total order; Spark prunes the groups before it sorts them."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("__rank", rank).where(F.col("__rank") <= keep)
    return out.withColumnRenamed("__rank", name) if name else out.drop("__rank")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (the session is in UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def _folder(df: DataFrame) -> str:
    """The folder that the session names in spark.checkpoint.dir; only a local session may name none, and gets its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrazzo-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder for checkpoints."""
    _folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A table written to the folder for checkpoints and read again.

    A checkpoint keeps the size that its plan estimates, for a join the product of both sides. In a
    loop that joins its own results that number gets twice as many digits in each round, until planning
    takes minutes; a written table has its real size.
    """
    path = f"{_folder(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
