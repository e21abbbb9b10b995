"""Text, JSON Lines, Parquet and in-memory sources, each a DataFrame of (doc_id, text)."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Paths = "str | os.PathLike | Sequence[str | os.PathLike]"


def as_separator(separator: str | bytes | None) -> str | None:
    """Text of a separator; bytes have to be UTF-8."""
    return separator.decode("utf-8") if isinstance(separator, (bytes, bytearray)) else separator


def path_list(paths: Paths) -> list[str]:
    many = [paths] if isinstance(paths, (str, os.PathLike)) else list(paths)
    if not many:
        raise ValueError("a source needs a path")
    return [os.fspath(p) for p in many]


def hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def check_exists(spark: SparkSession, path: str) -> None:
    """Asks the file system that the path belongs to."""
    if not any(c in path for c in "*?[{"):
        fs, where = hadoop_path(spark, path)
        if not fs.exists(where):
            raise FileNotFoundError(f"no such file: {path}")


def is_empty_file(spark: SparkSession, path: str) -> bool:
    if any(c in path for c in "*?[{"):
        return False
    fs, where = hadoop_path(spark, path)
    status = fs.getFileStatus(where)
    return status.isFile() and status.getLen() == 0


SMALL_BYTES = 64 << 20


def spread(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """A small table, by the bytes that its scan is planned with, over all cores; a larger one as it is.

    A file of few row groups would be one task's. The shuffle of at most ``limit`` bytes costs less than that;
    beyond it tables have row groups enough, and aren't shuffled.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if cores > 1 and size <= limit else df


class Source(ABC):
    """A corpus. ``documents`` gives its rows in the order of the paths given, then of the file."""

    def __init__(self, *args, **kwargs):
        if type(self) is Source:
            raise TypeError("Source itself can't be made; use one of its kinds")

    @abstractmethod
    def documents(self, spark: SparkSession) -> DataFrame:
        """(doc_id LONG, text STRING); doc_id rises in document order."""

    def training_documents(self, spark: SparkSession) -> DataFrame:
        """The same without empty documents, which hold nothing to count."""
        return self.documents(spark).filter("text <> ''")

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in vars(self).items())})"


class FileSource(Source):
    paths: list[str]

    def read_one(self, spark: SparkSession, path: str) -> DataFrame:
        raise NotImplementedError

    def documents(self, spark: SparkSession) -> DataFrame:
        """A file's rows keep their order through monotonically increasing ids; paths come in the order given, and each is a scan.

        A folder or a pattern is one path: a corpus of very many files is best given so.
        """
        out = None
        for path in self.paths:
            check_exists(spark, path)
            one = self.read_one(spark, path).select("text")
            out = one if out is None else out.unionAll(one)
        # partitions of a union are numbered in the order of its parts
        return out.select(F.monotonically_increasing_id().alias("doc_id"), "text")


class TextSource(FileSource):
    """Documents lie between separators, which belong to none; without one a file is a document.

    With a separator empty documents are skipped; without, an empty file is an empty document.
    """

    def __init__(self, paths: Paths, separator: str | bytes | None = None):
        self.paths, self.separator = path_list(paths), as_separator(separator)

    def read_one(self, spark, path):
        if self.separator:
            return spark.read.option("lineSep", self.separator).text(path).select(F.col("value").alias("text")).filter("text <> ''")
        rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
        if is_empty_file(spark, path):
            return spark.createDataFrame([("",)], "text string")
        return rows


class JsonlSource(FileSource):
    """A string field of each line. Malformed lines raise; ``on_error='skip'`` drops them, and lines without the field.

    Blank lines are skipped.
    """

    def __init__(self, paths: Paths, field: str = "text", on_error: str = "raise"):
        if on_error not in ("raise", "skip"):
            raise ValueError(f"on_error is 'raise' or 'skip', not {on_error!r}")
        self.paths, self.field, self.on_error = path_list(paths), field, on_error

    def read_one(self, spark, path):
        mode = "FAILFAST" if self.on_error == "raise" else "PERMISSIVE"
        schema = T.StructType([T.StructField(self.field, T.StringType())])
        lines = spark.read.text(path).filter(F.trim("value") != "")
        row = F.from_json("value", schema, {"mode": mode}).getField(self.field)
        if self.on_error == "raise":
            row = F.coalesce(row, F.raise_error(F.lit(f"a line of {path} has no string field {self.field!r}")))
        return lines.select(row.alias("text")).filter(F.col("text").isNotNull())


class ParquetSource(FileSource):
    """A string or binary column; a null is an empty document. Only that column is read."""

    def __init__(self, paths: Paths, column: str = "text"):
        self.paths, self.column = path_list(paths), column

    def read_one(self, spark, path):
        df = spark.read.parquet(path)
        if self.column not in df.columns:
            raise ValueError(f"no column {self.column!r} in {path} (available: {', '.join(df.columns)})")
        kind = df.schema[self.column].dataType
        if not isinstance(kind, (T.StringType, T.BinaryType)):
            raise TypeError(f"column {self.column!r} of {path} is {kind.simpleString()}, not string or binary")
        return df.select(F.coalesce(F.col(f"`{self.column}`").cast("string"), F.lit("")).alias("text"))


class BytesSource(Source):
    """Documents in memory; each may hold several, parted by a separator."""

    def __init__(self, data: bytes | str | Iterable[bytes | str], separator: str | bytes | None = None):
        self.data = [data] if isinstance(data, (bytes, bytearray, str)) else list(data)
        if len({isinstance(d, str) for d in self.data}) > 1:
            raise TypeError("texts and bytes are mixed")
        self.separator = as_separator(separator)

    def pieces(self) -> list[str] | list[bytes]:
        """The documents, parted and without empty ones if there is a separator."""
        if self.separator is None:
            return list(self.data)
        sep = {True: self.separator, False: self.separator.encode()}
        return [p for d in self.data for p in (d if isinstance(d, str) else bytes(d)).split(sep[isinstance(d, str)]) if p]

    def documents(self, spark):
        """(doc_id, text); text is BINARY if any document isn't UTF-8, so that no byte is lost, else STRING."""
        rows = self.pieces()
        try:
            texts = [d if isinstance(d, str) else bytes(d).decode("utf-8") for d in rows]
            return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        except UnicodeDecodeError:
            return spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(rows)], "doc_id long, text binary")

    def training_documents(self, spark):
        return self.documents(spark).filter(F.length("text") > 0)

    def __repr__(self):
        return f"BytesSource({len(self.data)} buffers, separator={self.separator!r})"


def detect_format(path: str | os.PathLike) -> str:
    """``jsonl``, ``parquet`` or ``text``, by the extension before a .gz, .zst or .zstd."""
    name = os.path.basename(os.fspath(path).rstrip("/")).lower()
    for end in (".gz", ".zst", ".zstd"):
        name = name.removesuffix(end)
    return "jsonl" if name.endswith(".jsonl") else "parquet" if name.endswith(".parquet") else "text"


def resolve(source: Source | Paths) -> Source:
    """A source as it is; of paths, the kind that the first one's extension tells."""
    if isinstance(source, Source):
        return source
    paths = path_list(source)
    return {"jsonl": JsonlSource, "parquet": ParquetSource, "text": TextSource}[detect_format(paths[0])](paths)


def as_documents(spark: SparkSession, source: DataFrame | Source | Paths) -> DataFrame:
    return source if isinstance(source, DataFrame) else resolve(source).documents(spark)
