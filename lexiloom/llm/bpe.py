"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Distinct words are laid out as one linked list of symbols. An inverted index leads
from each token pair, named by the rank of its merge, to the positions of its left
symbols. Every merge is applied in rank order to all its positions at once; only
the two neighbours of a merged symbol are touched, and the pairs that arise enter
the index. As a word's merges depend on nothing outside it, a worker replays the
words that it hasn't met yet, a chunk of the corpus at a time, and keeps their ids:
this equals one replay over the whole corpus, and no text is shuffled.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbering, chunks, narrow, offsets, ragged

CHUNK_BYTES = 2 << 20
#: Words and bytes of words that a worker keeps the ids of; beyond either it begins anew.
KEPT_WORDS, KEPT_BYTES = 150_000, 6 << 20


def word_pattern(letters: str = r"\p{L}", digits: str = r"\p{N}", spaces: str = r"\s", others: str = r"\S") -> str:
    contraction = "'(?:" + "|".join(["[sdmt]", "ll", "ve", "re"]) + ")"
    runs = [f" ?[{c}]+" for c in (letters, digits, f"^{spaces}{letters}{digits}")]
    return "|".join([contraction, *runs, f"[{spaces}]+(?!{others})", f"[{spaces}]+"])


class Splitter:
    """Words of a text. ASCII texts, where the classes are ranges, go through the faster of two engines."""

    def __init__(self):
        import regex

        self.any = regex.compile(word_pattern()).findall
        self.ascii = re.compile(word_pattern("A-Za-z", "0-9", "\t-\r ", "[^\t-\r ]")).findall

    def __call__(self, text: str | None) -> list[str]:
        return (self.ascii if text.isascii() else self.any)(text) if text else []


def printable_bytes() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass(frozen=True)
class Merges:
    """keys: sorted left * 2**32 + right; rank of each; by rank: left, right and merged id."""

    keys: np.ndarray
    ranks: np.ndarray
    left: np.ndarray
    right: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray
    token_bytes: np.ndarray
    token_at: np.ndarray

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @cached_property
    def encoder(self) -> Encoder:
        """One in each worker."""
        return Encoder(self)

    @staticmethod
    def build(tokens: list[bytes], pairs: list[tuple[int, int, int]]) -> Merges:
        """tokens by id; pairs (left, right, merged) in rank order."""
        index = {t: i for i, t in reversed(list(enumerate(tokens)))}
        missing = [b for b in range(256) if bytes([b]) not in index]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        seen, rows = set(), []
        for a, b, c in pairs:
            if (a, b) not in seen:
                seen.add((a, b))
                rows.append((a, b, c))
        made = {index[bytes([b])]: -1 for b in range(256)}
        for rank, (a, b, c) in enumerate(rows):
            # replay in rank order needs each part to exist before it is merged
            if made.get(a, rank) >= rank or made.get(b, rank) >= rank:
                raise ValueError(f"merge {rank} uses a token that no earlier merge makes")
            made.setdefault(c, rank)
        m = np.array(rows, np.int64).reshape(-1, 3)
        keys = (m[:, 0] << 32) | m[:, 1]
        order = np.argsort(keys, kind="stable")
        return Merges(
            keys[order],
            order.astype(np.int64),
            m[:, 0].astype(np.int32),
            m[:, 1].astype(np.int32),
            m[:, 2].astype(np.int32),
            np.array([index[bytes([b])] for b in range(256)], np.int32),
            np.frombuffer(b"".join(tokens), np.uint8),
            offsets(np.array([len(t) for t in tokens])),
        )

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is no such merge."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int64)
        k = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, k)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == k, self.ranks[at], -1)


def load_merges(path: str) -> Merges:
    """From a tokenizer.json of a byte-level BPE, or a .tiktoken file of ranks; once for each state of the file."""
    return read_merges(path, os.stat(path).st_mtime_ns)


@lru_cache(maxsize=2)
def read_merges(path: str, _changed: int) -> Merges:
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = printable_bytes()
        size = max(model["vocab"].values()) + 1
        tokens = [b""] * size
        for t, i in model["vocab"].items():
            tokens[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        pairs = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append((model["vocab"][a], model["vocab"][b], model["vocab"][a + b]))
        return Merges.build(tokens, pairs)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    pairs = []
    for i, t in enumerate(tokens):
        if len(t) > 1:
            parts = split_below(t, ranks, i)
            if len(parts) == 2:
                pairs.append((ranks[parts[0]], ranks[parts[1]], i))
    return Merges.build(tokens, pairs)


def split_below(token: bytes, ranks: dict[bytes, int], limit: int) -> list[bytes]:
    """What merges of less than ``limit`` leave of ``token``, one pair at a time."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], limit), i))
        if ranks.get(parts[best] + parts[best + 1], limit) >= limit:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def replay(words: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after the other, and the number of ids of each."""
    lengths = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int32), lengths
    sym = m.byte_ids[raw].astype(np.int32)
    at = np.arange(n, dtype=np.int32)
    nxt, prv = at + 1, at - 1
    ends = offsets(lengths)
    full = lengths > 0
    nxt[ends[1:][full] - 1] = -1
    prv[ends[:-1][full]] = -1
    index: list[list[np.ndarray] | None] = [None] * len(m.merged)

    def enter(pos: np.ndarray) -> None:
        rank = m.rank_of(sym[pos], sym[nxt[pos]])
        known = rank >= 0
        pos, rank = pos[known], rank[known]
        if not len(pos):
            return
        order = np.argsort(rank, kind="stable")
        pos, rank = pos[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        begin = 0
        for end in [*cuts.tolist(), len(pos)]:
            r = int(rank[begin])
            if index[r] is None:
                index[r] = []
            index[r].append(pos[begin:end])
            begin = end

    enter(at[nxt >= 0])
    for r in range(len(m.merged)):
        found = index[r]
        if found is None:
            continue
        index[r] = None
        pos = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        a, b = m.left[r], m.right[r]
        pos = pos[sym[pos] == a]
        right = nxt[pos]
        ok = right >= 0
        ok[ok] = sym[right[ok]] == b
        pos, right = pos[ok], right[ok]
        if not len(pos):
            continue
        if a == b and len(pos) > 1:
            # of overlapping pairs, every second one counting from the left of its run
            pos = np.sort(pos)
            joined = np.concatenate([[False], nxt[pos[:-1]] == pos[1:]])
            k = np.arange(len(pos))
            run = np.maximum.accumulate(np.where(joined, 0, k))
            pos = pos[(k - run) % 2 == 0]
            right = nxt[pos]
        after = nxt[right]
        sym[pos] = m.merged[r]
        sym[right] = -1
        nxt[pos] = after
        inner = after >= 0
        prv[after[inner]] = pos[inner]
        before = prv[pos]
        enter(np.unique(np.concatenate([before[before >= 0], pos[inner]])))
    alive = sym >= 0
    counts = np.add.reduceat(np.append(alive, False).astype(np.int64), ends[:-1]) if len(words) else lengths
    counts[~full] = 0
    return sym[alive], counts


class Encoder:
    """Ids of the words met so far, one after the other."""

    def __init__(self, m: Merges):
        self.merges, self.split = m, Splitter()
        self.clear()

    def clear(self) -> None:
        self.number = Numbering()
        self.ids, self.begin, self.bytes = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        if len(self.number) > KEPT_WORDS or self.bytes > KEPT_BYTES:
            self.clear()
        lines = list(map(self.split, texts))
        sizes = np.array([len(x) for x in lines], np.int64)
        where = np.fromiter(map(self.number.__getitem__, chain.from_iterable(lines)), np.int64, int(sizes.sum()))
        fresh = [w.encode("utf-8", "surrogatepass") for w in islice(self.number, len(self.begin) - 1, None)]
        if fresh:
            ids, counts = replay(fresh, self.merges)
            self.ids = np.concatenate([self.ids, ids])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
            self.bytes += sum(map(len, fresh))
        each = self.begin[where + 1] - self.begin[where]
        total = offsets(each)
        return self.ids[ragged(self.begin[where], each)], np.diff(total[offsets(sizes)])


def bpe_encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids ARRAY<INT>, n_tokens INT) of each row of ``docs``.

    A null text has null token_ids and n_tokens; an empty one has none and 0. Ids may be
    null or repeat, and are cast to LONG: each row is encoded by itself. Other columns are left out. Texts are
    encoded whole; special tokens in them are ordinary text.
    """
    m = docs.sparkSession.sparkContext.broadcast(load_merges(vocab_path))  # its size is the vocabulary's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK_BYTES):
            texts = t.column("text").to_pylist()
            ids, counts = m.value.encoder.encode(texts)
            null = np.array([x is None for x in texts])
            lists = pa.ListArray.from_arrays(pa.array(offsets(counts).astype(np.int32), pa.int32(), mask=np.append(null, False)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), lists, pa.array(counts.astype(np.int32), mask=null)], names=["id", "token_ids", "n_tokens"])

    out = narrow(docs, id_col, text_col).mapInArrow(run, "id long, token_ids array<int>, n_tokens int")
    return out.withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocab_path: str, ids_col: str = "token_ids", out_col: str = "text") -> DataFrame:
    """``encoded`` with the decoded text in ``out_col``.

    Null ids give null, no ids an empty text. Bytes that are not UTF-8 become U+FFFD. An id
    outside the vocabulary, or a null in the list, raises. An ``out_col`` that is there already is replaced.
    """
    m = encoded.sparkSession.sparkContext.broadcast(load_merges(vocab_path))
    encoded = encoded.drop(out_col)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, start = m.value.token_bytes, m.value.token_at
        size = start[1:] - start[:-1]
        for b in batches:
            col = b.column(at)
            begin, end = col.offsets.to_numpy()[[0, -1]]
            if col.values.slice(begin, end - begin).null_count:
                raise ValueError("a list of token ids holds a null")
            ids = col.values.slice(begin, end - begin).to_numpy()
            if len(ids) and (ids.min() < 0 or ids.max() >= len(size)):
                raise ValueError("a token id is outside the vocabulary")
            flat = raw[ragged(start[ids], size[ids])].tobytes()
            ends = offsets(size[ids])[col.offsets.to_numpy() - begin]
            null = col.is_null().to_pylist()
            texts = [None if null[i] else flat[ends[i] : ends[i + 1]].decode("utf-8", "replace") for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))
