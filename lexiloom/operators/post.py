"""Padding, truncation, masks and scans, all as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoint import cut


def ints(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast("array<int>")


def keep(ids: Column, n: Column | int, from_right: bool) -> Column:
    """The first or last ``n`` elements."""
    n = F.lit(n) if isinstance(n, int) else n
    size = F.size(ids)
    return F.when(size <= n, ids).when(n == 0, ints([])).otherwise(F.slice(ids, size - n + 1 if from_right else F.lit(1), n))


def room(max_length: int, extra: int) -> int:
    if max_length < extra:
        raise ValueError(f"max_length {max_length} has no room for {extra} special tokens a sequence")
    return max_length - extra


@dataclass(frozen=True)
class PadTruncate:
    pad_id: int
    max_length: int | None = None
    pad_to_max_length: bool = False
    truncate: bool = False
    pad_left: bool = False
    truncate_left: bool = False
    prefix: tuple[int, ...] = ()
    suffix: tuple[int, ...] = ()

    def __post_init__(self):
        if self.truncate and self.max_length is None:
            raise ValueError("truncation takes a max_length")
        if self.pad_to_max_length and self.max_length is None:
            raise ValueError("padding to max_length takes a max_length")
        if self.truncate:
            room(self.max_length, len(self.prefix) + len(self.suffix))


def wrap_truncate(ids: Column | str, prefix: Sequence[int] = (), suffix: Sequence[int] = (), max_tokens: int | None = None, truncate_left: bool = False) -> Column:
    """prefix, at most ``max_tokens`` of the ids, suffix; of null ids null."""
    col = F.col(ids) if isinstance(ids, str) else ids
    kept = col if max_tokens is None else keep(col, max_tokens, truncate_left)
    return F.concat(ints(prefix), kept, ints(suffix)) if prefix or suffix else kept


def pad_truncate(df: DataFrame, options: PadTruncate, ids_col: str = "ids", batch_col: str | None = None) -> DataFrame:
    """``df`` with input_ids, attention_mask and length.

    Rows are padded to max_length, or to the longest of the DataFrame, or of its batch if ``batch_col`` is given.
    A row over max_length without truncation raises. Null ids count as none. Where the longest row has to be found, the
    rows are kept in a checkpoint first, by a job that runs at once, so that nothing is encoded twice.
    """
    o = options
    extra = len(o.prefix) + len(o.suffix)
    ids = F.coalesce(F.col(ids_col), ints([]))
    rows = wrap_truncate(ids, o.prefix, o.suffix, o.max_length - extra if o.truncate else None, o.truncate_left)
    out = df.withColumn("__row", rows).withColumn("length", F.size("__row"))
    if o.pad_to_max_length:
        long = F.raise_error(F.concat(F.lit("a sequence has "), F.col("length").cast("string"), F.lit(f" ids, which is more than max_length {o.max_length}, and truncation is off")))
        out = out.withColumn("__width", F.when(F.col("length") > o.max_length, long.cast("int")).otherwise(o.max_length))
    elif batch_col is None:
        out = cut(out)  # two passes over the ids, one over the texts
        out = out.crossJoin(out.agg(F.max("length").alias("__width")))
    else:
        out = cut(out)
        widths = out.groupBy(F.col(batch_col).alias("__batch")).agg(F.max("length").alias("__width"))
        out = out.join(widths, F.col(batch_col).eqNullSafe(F.col("__batch"))).drop("__batch")
    gap = F.col("__width") - F.col("length")
    pads, zeros, ones = (F.array_repeat(F.lit(v), n) for v, n in ((o.pad_id, gap), (0, gap), (1, F.col("length"))))
    order = (lambda filler, body: F.concat(filler, body)) if o.pad_left else (lambda filler, body: F.concat(body, filler))
    return out.withColumns({"input_ids": order(pads, F.col("__row")), "attention_mask": order(zeros, ones)}).drop("__row", "__width")


def attention_mask(ids: Column | str) -> Column:
    """Ones, as many as there are ids."""
    col = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(col, lambda _: F.lit(1))


def is_rectangular(df: DataFrame, ids_col: str = "ids") -> bool:
    """Whether all rows have as many ids, so that they make a matrix."""
    lo, hi = df.agg(F.min(F.size(ids_col)), F.max(F.size(ids_col))).first()
    return lo == hi


def contains_any(text: Column | str, patterns: Sequence[str]) -> Column:
    """Whether any pattern, literal, occurs."""
    col = F.col(text) if isinstance(text, str) else text
    some = [p for p in patterns if p]
    return col.rlike("|".join(re.escape(p) for p in some)) if some else F.lit(False)


def patterns_found(text: Column | str, patterns: Sequence[str]) -> Column:
    """ARRAY<INT>: the numbers of the patterns that occur, overlapping or not; an empty one occurs nowhere."""
    col = F.col(text) if isinstance(text, str) else text
    each = F.array(*[F.when(F.contains(col, F.lit(p)), F.lit(k)) for k, p in enumerate(patterns) if p] or [F.lit(None).cast("int")])
    return F.filter(each, lambda x: x.isNotNull())


def forbidden_counts(docs: DataFrame, patterns: Sequence[str], text_col: str = "text") -> DataFrame:
    """(pattern, documents) for each pattern: in how many texts it occurs."""
    aggs = [F.count(F.when(F.contains(F.col(text_col), F.lit(p)), 1)).alias(f"c{k}") for k, p in enumerate(patterns)]
    one = docs.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"c{k}").alias("documents")) for k, p in enumerate(patterns)])).alias("x")).select("x.*")


class SubstringMatcher:
    """The same scan of single texts on the driver."""

    def __init__(self, patterns: Sequence[str]):
        self.patterns = list(patterns)

    def __len__(self) -> int:
        return len(self.patterns)

    def present(self, text: str) -> list[int]:
        return [k for k, p in enumerate(self.patterns) if p and p in text]


def drop_ids(ids: Column | str, unwanted: Sequence[int]) -> Column:
    """The ids without the unwanted, such as those of special tokens."""
    col = F.col(ids) if isinstance(ids, str) else ids
    return F.filter(col, lambda i: ~i.isin(*unwanted)) if unwanted else col
