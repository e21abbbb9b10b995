"""Encoding and counting of streams. An extension: state is kept by Spark, and only for counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.pretokens import pretokenize
from ..operators.encode import encode
from ..plans.model import Model


def read_documents(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(folder)


def encode_stream(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Each row by itself, without state."""
    return encode(docs, model, text_col, out_col)


def running_counts(docs: DataFrame, scheme: str = "gpt2", text_col: str = "text") -> DataFrame:
    """Counts of pretokens so far, for complete or update mode. The state holds the distinct pretokens."""
    return docs.select(F.explode(pretokenize(text_col, scheme)).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("count"))


def windowed_tokens(docs: DataFrame, model: Model, time_col: str, text_col: str = "text", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, tokens, rows) by windows of event time; rows later than the watermark are dropped, and with them the state."""
    ids = encode(docs.withWatermark(time_col, late), model, text_col, "__ids")
    return ids.groupBy(F.window(time_col, window).alias("w")).agg(F.sum(F.size("__ids")).alias("tokens"), F.count("*").alias("rows")).select("w.start", "tokens", "rows")


def to_parquet(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each row once: what was written is noted in the checkpoint folder."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
