"""Encoding and decoding as DataFrame operators and column functions.

Texts are encoded where they lie: no shuffle. The model travels once to each
worker in a broadcast; its size is the vocabulary's, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.kernels import ends_of
from ..plans.model import Model
from .checkpoint import cut

BATCH_BYTES = 1 << 20
#: Most words of a dictionary, and most characters of each: some 10 MB.
DICTIONARY_WORDS, DICTIONARY_CHARS = 50_000, 64


def short_batches(spark: SparkSession) -> None:
    """Whole texts and their ids go to Python: Arrow's batches of 10,000 rows would take a worker memory that grows with the texts."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        size = int(re.sub(r"\D", "", now or "") or 0) << {"k": 10, "m": 20, "g": 30}.get((now or "").lower().rstrip("b")[-1:], 0)
        if not 0 < size <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def parts(b: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch cut by rows so that each part holds about ``limit`` bytes."""
    rows = max(1, b.num_rows * limit // max(1, b.nbytes))
    for k in range(0, b.num_rows, rows):
        yield b.slice(k, rows)


def id_lists(ids: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends_of(counts).astype(np.int32), mask=np.append(null, False)), pa.array(ids, pa.int32()))


def schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "ids", special: bool = True, keep_text: bool = True) -> DataFrame:
    """``docs`` with the token ids of a STRING or BINARY column; of a null text null, of an empty one none.

    Bytes that are not UTF-8 pass through byte-level models. An ``out_col`` that is there is replaced.
    """
    short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.drop(out_col) if out_col != text_col else docs
    if not keep_text:
        df = df.select(*[c for c in df.columns if c != text_col], text_col)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole):
                col = b.column(at)
                ids, counts = held.value.encode_batch(col.to_pylist(), special)
                lists = id_lists(ids, counts, np.array(col.is_null().to_pylist(), bool))
                kept = list(zip(b.columns, b.schema.names))
                if not keep_text or out_col == text_col:
                    kept = [k for k in kept if k[1] != text_col]
                yield pa.RecordBatch.from_arrays([*[k[0] for k in kept], lists], names=[*[k[1] for k in kept], out_col])

    rest = df if keep_text and out_col != text_col else df.drop(text_col)
    return df.mapInArrow(run, schema_with(rest, out_col, T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids", out_col: str = "text", binary: bool = False) -> DataFrame:
    """``encoded`` with the text of the ids; of null ids null. Not UTF-8: U+FFFD, or all bytes if ``binary``."""
    short_batches(encoded.sparkSession)
    held = encoded.sparkSession.sparkContext.broadcast(model)
    df = encoded.drop(out_col)
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole):
                col = b.column(at)
                off = col.offsets.to_numpy()
                null = col.is_null().to_pylist()
                each = held.value.decode_flat(col.values.slice(off[0], off[-1] - off[0]).to_numpy(), np.diff(off))
                raw = [None if n else r for n, r in zip(null, each)]
                out = pa.array(raw, pa.binary()) if binary else pa.array([None if r is None else r.decode("utf-8", "replace") for r in raw], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, schema_with(df, out_col, T.BinaryType() if binary else T.StringType()))


def encode_udf(model: Model, special: bool = True) -> Callable[[Column | str], Column]:
    """A column function, for expressions and ``spark.udf.register``."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        short_batches(spark)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts):
        import pandas as pd

        ids, counts = model.encode_batch(texts, special)
        rows = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []
        return pd.Series([None if t is None else r for t, r in zip(texts, rows)], dtype=object)

    return run


def decode_udf(model: Model) -> Callable[[Column | str], Column]:
    @F.pandas_udf(T.StringType())
    def run(rows):
        import pandas as pd

        return pd.Series([None if r is None else model.decode(r).decode("utf-8", "replace") for r in rows], dtype=object)

    return run


def joined_rows(parts: DataFrame, id_col: str, out_col: str) -> DataFrame:
    """(id, out_col): ids of (id, __h, __pos, __ids) in the order of __pos, one row for each that ``parts`` was made of.

    __h is a hash of the text: rows that share an id but not a text stay apart, and those that share both have
    equal parts, which are counted. A null __pos is a null text.
    """
    key = [F.col(id_col), F.col("__h")]
    once = parts.groupBy(*key, "__pos").agg(F.count("*").alias("__n"), F.first("__ids").alias("__ids"))
    rows = once.groupBy(*key).agg(F.max("__n").alias("__n"), F.max(F.col("__pos").isNotNull()).alias("__known"), F.array_sort(F.collect_list(F.struct("__pos", "__ids"))).alias("__x"))
    whole = F.when(F.col("__known"), F.flatten(F.transform("__x", lambda x: F.coalesce(x["__ids"], F.array().cast("array<int>")))))
    return rows.select(id_col, whole.alias(out_col), F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(id_col, out_col)


def encode_through_dictionary(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """(id, ids): distinct pretokens are counted in the whole corpus and encoded once, and a broadcast takes their ids to the texts.

    The dictionary holds the most frequent pretokens of up to DICTIONARY_CHARS characters that occur twice or more,
    DICTIONARY_WORDS of them at most, whatever the corpus; others are encoded where they occur, as ``encode`` does, so that no
    text and no place of a pretoken is shuffled. It is made by jobs that run at once. Ids may be null or repeat; of a null text the ids are null, of an
    empty one none. Models with added tokens, prefix space or NFC take ``encode``.
    """
    from ..functions.pretokens import pretoken_counts

    if model.added or getattr(model, "prefix_space", True) or model.nfc:
        raise ValueError("this model cuts texts before it pretokenizes; use encode")
    counts = cut(pretoken_counts(docs, model.scheme, text_col).filter(F.length("pretoken").between(1, DICTIONARY_CHARS) & (F.col("count") > 1)))
    # eighths of powers of two, from the most frequent words on as far as the dictionary holds: no partition sends more than its words
    step = F.floor(F.log2("count") * 8)
    least, total = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        total += r["count"]
        if total > DICTIONARY_WORDS:
            break
        least = r["step"]
    words = sorted(r["pretoken"] for r in counts.filter(step >= least).collect()) if least is not None else []
    known = (tuple(words), *model.encode_words(words)) if words else None
    return encode(docs.select(id_col, text_col), replace(model, known=known), text_col, out_col, special=False, keep_text=False)


def token_totals(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """One row (pretokens, tokens, bytes) of the corpus: distinct pretokens are encoded once and weighted by their counts."""
    from ..functions.pretokens import pretoken_counts

    counts = encode(pretoken_counts(docs, model.scheme, text_col), model, "pretoken", "ids", special=False)
    weighted = lambda c: F.coalesce(F.sum(F.col("count") * c), F.lit(0)).cast("long")
    return counts.agg(weighted(F.lit(1)).alias("pretokens"), weighted(F.size("ids")).alias("tokens"), weighted(F.octet_length("pretoken")).alias("bytes"))


def encode_giant(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", target: int = 1 << 20) -> DataFrame:
    """(id, ids) with long texts cut into ranges that are encoded in parallel and put together again.

    The cuts change no ids; models for which no such cut is known are refused: byte-level ones whose text is one
    word or that add a prefix space, and piece models with tokens that cross into a mark. Ids may be null or
    repeat; of a null text the ids are null.
    """
    cut_up = model.safe_parts(target)
    short_batches(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def split(texts):
        import pandas as pd

        return pd.Series([None if t is None else [t] if len(t) < target else cut_up(t) for t in texts], dtype=object)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(id_col, F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("__h"), F.posexplode_outer(split(F.col(text_col))).alias("__pos", "__part")).repartition(n, id_col, "__h", "__pos")
    whole = encode(rows.filter("__pos is null or __pos = 0"), model, "__part", "__ids", keep_text=False)
    later = encode(rows.filter("__pos > 0"), model.continued(), "__part", "__ids", keep_text=False)
    return joined_rows(whole.unionByName(later), id_col, out_col)
