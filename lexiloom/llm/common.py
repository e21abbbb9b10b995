"""What the operators of this package share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def short_batches(spark: SparkSession) -> None:
    """Whole texts go to Python: Arrow's batches of 10,000 rows would take too much of a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id LONG, text STRING), whatever else the table holds, in Arrow batches of 1,000 rows at most."""
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has."""
    lead = "__"
    while any(c.lower().startswith(lead) for c in df.columns):
        lead += "_"
    return [lead + n for n in names]


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint.

    The folder is the one that the session names in ``spark.checkpoint.dir``. Where that is unset, a
    local session (tests) uses a temporary folder, and any other raises: its executors would share none.
    This runs a job at once, whether or not the result is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="lexiloom-")


SMALL_ROWS = 100_000


def if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A table that is usually small, counted, and marked for broadcast if it has at most ``rows`` rows.

    Beyond that it is joined by shuffles, as Spark decides.
    """
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Joins Arrow batches until they hold about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        while b.num_rows:
            # a batch may itself be larger than the limit: cut it by rows
            take = b.num_rows if b.nbytes <= limit else max(1, b.num_rows * limit // max(1, b.nbytes))
            held.append(b.slice(0, take))
            size += held[-1].nbytes
            b = b.slice(take)
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... for each i, one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)


def offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


class Numbering(dict):
    """Numbers keys in the order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n
