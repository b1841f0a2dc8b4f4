"""Shared pieces of the training-data operators."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, by a path that only Spark needs to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str, directory: str | None = None) -> str:
    """Path of a public vocabulary file; the directory is a parameter, the file is never copied."""
    if directory:
        return os.path.join(directory, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that the session names in spark.checkpoint.dir.

    Only a local session (as in tests) may name none; it gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or f"/tmp/terrazzo-checkpoints/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


#: Rows that a Python worker holds at a time, in and out.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with the session's Arrow batches no larger than BATCH_ROWS: texts are long, and a
    worker's memory is a multiple of its batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    now = int(conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def n_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(lengths: list[int], most: int):
    """Row ranges of at most `most` units each (a longer row stands alone)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
