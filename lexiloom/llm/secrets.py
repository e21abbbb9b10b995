"""Secret scans by sliding-window entropy.

Candidates are maximal runs of token characters. For each character class, a
window slides over every part of a candidate whose characters are all of that
class; counts of the window's characters are kept up incrementally, and with
them its Shannon entropy. Entropies are whole millionths of a bit, so that no
order of summing changes a decision. Allow-listed candidates are suppressed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, short_batches

CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Bits a character; a window of 20 can reach 4 (hexadecimal) or 4.32. About one in a hundred windows of random characters is below its bound (upper: 3 in 100).
CLASSES = {"hex": ("0-9a-f", 2.9), "hex_upper": ("0-9A-F", 2.9), "lower": ("0-9a-z", 3.4), "upper": ("0-9A-Z", 3.5), "base64": ("A-Za-z0-9+/_-", 3.6)}
ALLOW = (
    "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUID
    "[^0-9]+",  # no digit: words, paths, rules
    "[0-9/_-]+",  # numbers, dates
    ".*(?:EXAMPLE|example|0123456789|abcdefghij).*",
)
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rules:
    candidate: str = CANDIDATE
    window: int = WINDOW
    classes: dict[str, tuple[str, float]] = field(default_factory=lambda: dict(CLASSES))
    allow: tuple[str, ...] = ALLOW


def weights(window: int) -> list[int]:
    """n log2 n in millionths."""
    return [0, *(round(1e6 * n * math.log2(n)) for n in range(1, window + 1))]


def window_entropies(s: str, window: int, table: list[int]) -> list[int]:
    """Entropy, in millionths of a bit times ``window``, of each window of ``s``."""
    if len(s) < window:
        return []
    counts: dict[str, int] = {}
    total, out = 0, []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += table[n + 1] - table[n]
        counts[c] = n + 1
        if i >= window:
            n = counts[s[i - window]]
            total += table[n - 1] - table[n]
            counts[s[i - window]] = n - 1
        if i >= window - 1:
            out.append(table[window] - total)
    return out


class Scanner:
    def __init__(self, rules: Rules):
        self.candidate, self.window = re.compile(rules.candidate), rules.window
        self.table = weights(rules.window + 1)
        self.classes = [(name, re.compile(f"[{chars}]{{{rules.window},}}"), round(bits * 1e6) * rules.window) for name, (chars, bits) in rules.classes.items()]
        self.allow = re.compile("|".join(f"(?:{a})" for a in rules.allow)) if rules.allow else None

    def __call__(self, text: str | None) -> list[tuple[int, int, str, int, int]]:
        """(begin, end, class, windows, greatest entropy) of each candidate and class that is flagged."""
        out = []
        for m in self.candidate.finditer(text or ""):
            s = m.group()
            if self.allow and self.allow.fullmatch(s):
                continue
            for name, part, least in self.classes:
                h = [x for p in part.findall(s) for x in window_entropies(p, self.window, self.table)]
                n = sum(x >= least for x in h)
                if n:
                    out.append((m.start(), m.end(), name, n, max(h)))
        return out


def scan_secrets(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, begin, end, class, windows, entropy): one row for each flagged candidate and class.

    begin and end are characters of the text, end not included; windows: how many reach the class's
    bound; entropy: the greatest, in millionths of a bit a character times the window. Null and empty
    texts have no rows; ids may be null or repeat, each row is scanned by itself and whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(rules)
        for b in batches:
            rows = [(i, *f) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for f in scan(t)]
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["id", "begin", "end", "class", "windows", "entropy"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "id long, begin int, end int, class string, windows int, entropy long").withColumnRenamed("id", id_col)


def mask_secrets(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", length_col: str | None = "n_chars", mask: str = MASK) -> DataFrame:
    """``docs`` with every flagged candidate of the text masked, and ``length_col`` set to the new length of such texts.

    All other rows and columns stay as they are, a length that was null or wrong among them. No row goes; null and
    empty texts hold nothing. Without a column ``length_col`` of whole numbers, only texts change.
    """
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    whole = ("byte", "short", "integer", "long")
    size_at = docs.columns.index(length_col) if length_col in docs.columns and docs.schema[length_col].dataType.typeName() in whole else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(rules)
        for b in batches:
            texts = b.column(at).to_pylist()
            changed = []
            for k, t in enumerate(texts):
                found = sorted({f[:2] for f in scan(t)}, reverse=True)
                for begin, end in found:
                    texts[k] = texts[k][:begin] + mask + texts[k][end:]
                if found:
                    changed.append(k)
            if changed:
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                if size_at is not None:
                    sizes = b.column(size_at).to_pylist()
                    for k in changed:
                        sizes[k] = len(texts[k])
                    b = b.set_column(size_at, b.schema.field(size_at), pa.array(sizes, b.schema.field(size_at).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def sql(rules: Rules = Rules()) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table = weights(rules.window)
    classes = ", ".join(f"({quote(n)}, {quote(f'[{c}]{{{rules.window},}}')}, {round(b * 1e6) * rules.window})" for n, (c, b) in rules.classes.items())
    allow = " OR ".join(f"regexp_full_match(s, {quote(a)})" for a in rules.allow)
    return f"""
WITH cand AS (
  SELECT doc_id, k, cands[k] AS s,
    (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(cands[1:k-1], lambda x: length(x))), 0))::INTEGER AS begin
  FROM (SELECT doc_id, gaps, cands, unnest(range(1, len(cands) + 1)) AS k FROM (
    SELECT doc_id, string_split_regex(text, {quote(rules.candidate)}) AS gaps, regexp_extract_all(text, {quote(rules.candidate)}) AS cands FROM documents))),
w(n, v) AS (VALUES {", ".join(f"({n}, {v})" for n, v in enumerate(table))}),
c(class, part, least) AS (VALUES {classes}),
parts AS (SELECT doc_id, k, s, begin, class, least, p, row_number() OVER () AS part_id FROM (
  SELECT doc_id, k, s, begin, class, least, unnest(regexp_extract_all(s, part)) AS p FROM cand, c WHERE NOT ({allow}))),
wins AS (SELECT *, unnest(range(1, length(p) - {rules.window} + 2)) AS o FROM parts),
chars AS (SELECT part_id, o, unnest(string_split(substr(p, o, {rules.window}), '')) AS ch FROM wins),
counts AS (SELECT part_id, o, ch, count(*) AS n FROM chars GROUP BY ALL),
h AS (SELECT part_id, o, {table[rules.window]} - sum(v) AS h FROM counts JOIN w USING (n) GROUP BY part_id, o)
SELECT doc_id, begin, (begin + length(s))::INTEGER AS "end", class, count(*)::INTEGER AS windows, mx::BIGINT AS entropy
FROM (SELECT doc_id, k, s, begin, class, least, h, max(h) OVER (PARTITION BY doc_id, k, class) AS mx FROM parts JOIN h USING (part_id))
WHERE h >= least GROUP BY doc_id, k, s, begin, class, mx
"""
