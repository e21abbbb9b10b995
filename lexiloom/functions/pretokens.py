"""Pretokenization as column expressions, and the same for a single text."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schemes import Scheme, ascii_only, by_name, java, python


def split_isolated(piece: Column, pattern: str) -> Column:
    """Matches of ``pattern`` and what lies between them, in order."""
    between = f"(?:(?!{pattern})(?s:.))+"
    return F.regexp_extract_all(piece, F.lit(java(f"(?:{pattern})|{between}")), F.lit(0))


def pretokenize(text: Column | str, scheme: str | Scheme = "gpt2") -> Column:
    """ARRAY<STRING> of the pieces of ``text``, which joined are ``text``; of a null text null."""
    s = by_name(scheme) if isinstance(scheme, str) else scheme
    col = F.col(text) if isinstance(text, str) else text
    if s.whole:
        return F.when(col == "", F.array().cast("array<string>")).when(col.isNotNull(), F.array(col))
    if len(s.patterns) == 1:
        return F.regexp_extract_all(col, F.lit(java(s.patterns[0])), F.lit(0))

    def next_stage(pattern: str) -> Callable[[Column], Column]:
        return lambda piece: split_isolated(piece, pattern)

    pieces = split_isolated(col, s.patterns[0])
    for p in s.patterns[1:]:
        pieces = F.flatten(F.transform(pieces, next_stage(p)))
    return pieces


@lru_cache(maxsize=64)
def splitter(scheme: Scheme) -> Callable[[str], list[str]]:
    """The same for a Python string."""
    import regex

    if scheme.whole:
        return lambda text: [text] if text else []
    compiled = [regex.compile(python(p)) for p in scheme.patterns]
    if len(compiled) == 1:
        plain = ascii_only(scheme.patterns[0])
        if plain is None:
            return compiled[0].findall
        quick, full = re.compile(plain).findall, compiled[0].findall
        return lambda text: quick(text) if text.isascii() else full(text)

    def staged(text: str) -> list[str]:
        pieces = [text] if text else []
        for c in compiled:
            out = []
            for p in pieces:
                at = 0
                for m in c.finditer(p):
                    if m.end() == m.start():
                        continue
                    if m.start() > at:
                        out.append(p[at : m.start()])
                    out.append(m.group())
                    at = m.end()
                if at < len(p):
                    out.append(p[at:])
            pieces = out
        return pieces

    return staged


def pretoken_rows(docs: DataFrame, scheme: str = "gpt2", text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with pos and pretoken: a row for each piece."""
    rest = [c for c in docs.columns if c not in (text_col, "pos", "pretoken")]
    return docs.select(*rest, F.posexplode(pretokenize(text_col, scheme)).alias("pos", "pretoken"))


def pretoken_counts(docs: DataFrame, scheme: str = "gpt2", text_col: str = "text") -> DataFrame:
    """(pretoken, count): how often each occurs. Counted before the shuffle as well as after."""
    return docs.select(F.explode(pretokenize(text_col, scheme)).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("count"))


def split_documents(text: Column | str, separator: str) -> Column:
    """ARRAY<STRING> of the non-empty pieces between occurrences of ``separator``, which is literal; empty: the whole text."""
    col = F.col(text) if isinstance(text, str) else text
    whole = F.array(col) if not separator else F.split(col, re.escape(separator), -1)
    return F.filter(whole, lambda d: d != "")


def safe_ranges(text: bytes, target: int, added: Sequence[tuple[bytes, bool]] = ()) -> list[tuple[int, int]]:
    """Ranges of ``target`` bytes or somewhat more whose pieces are those of the whole.

    A cut comes before a space that an ASCII letter or digit precedes and an ASCII letter
    follows, where no added token (content, absorbs white space after it) is cut.
    """
    fixed = [t for t, _ in added if b" " in t]
    closing = [t for t, strips in added if strips and t[-1:].isalnum() and t[-1:].isascii()]
    reach = max((len(t) for t in fixed), default=1) - 1
    cut = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z])")

    def spoils(p: int) -> bool:
        near = text[max(0, p - reach) : p + reach]
        base = max(0, p - reach)
        for t in fixed:
            k = near.find(t)
            while k >= 0:
                if base + k < p < base + k + len(t):
                    return True
                k = near.find(t, k + 1)
        return any(text[:p].endswith(t) for t in closing)

    out, start = [], 0
    while start < len(text):
        m = cut.search(text, start + max(1, target))
        while m and spoils(m.start()):
            m = cut.search(text, m.start() + 1)
        end = m.start() if m else len(text)
        out.append((start, end))
        start = end
    return out or [(0, 0)]


def unit_counts(docs: DataFrame, max_bytes: int = 128, text_col: str = "text") -> DataFrame:
    """(unit, count) of the second training stage: lines, cut into pieces of ``max_bytes`` bytes at most.

    A cut doesn't part the bytes of a character unless a character alone is longer. ``unit`` holds a
    character for each byte (ISO 8859-1), so that string functions count bytes.
    """
    n = max(1, max_bytes)
    bytes_ = F.decode(F.encode(F.col(text_col), "UTF-8"), "ISO-8859-1")
    line = rf"[^\n]{{1,{n}}}"
    pieces = F.regexp_extract_all(bytes_, F.lit(rf"{line}(?![\x80-\xBF])|{line}"), F.lit(0))
    return docs.select(F.explode(pieces).alias("unit")).groupBy("unit").agg(F.count("*").alias("count"))
