"""Training of BPE and of two-stage (superword) BPE vocabularies.

Spark does what grows with the corpus: it splits, counts and sums. The merge loop
then runs over the distinct words alone: on the driver as long as they fit a
documented bound, beyond it over a partitioned table of words.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pretokens import pretoken_counts, split_documents, unit_counts
from ..functions.schemes import SCHEMES, by_name
from ..plans.kernels import PairTable, ends_of, merge_words, spread
from ..plans.loaders import bytes_unicode, unicode_bytes
from ..plans.model import AddedToken, ByteModel
from ..sources.readers import Source, as_documents, as_separator, resolve

TIES = ("huggingface", "raw_token_ids", "assembled_bytes")
SEPARATOR = "<|endoftext|>"
#: The driver merges distinct words of so many bytes in all, which take it some fifty times as much memory.
DRIVER_BYTES = 8 << 20
#: Beyond that: the bytes of words from which merges are foreseen, merges tried by one pass, symbols that a task replays at once.
SAMPLE_BYTES, AHEAD, CHUNK_SYMBOLS = 4 << 20, 512, 1 << 20


def count_pairs(words: DataFrame) -> DataFrame:
    """(l, r, count) of the adjacent symbols of (symbols ARRAY<INT>, count); overlapping pairs count each."""
    n = F.size("symbols") - 1
    pairs = F.arrays_zip(F.slice("symbols", F.lit(1), n), F.slice("symbols", F.lit(2), n)).cast("array<struct<l:int,r:int>>")
    rows = words.filter(F.size("symbols") > 1).select("count", F.explode(pairs).alias("p"))
    return rows.groupBy("p.l", "p.r").agg(F.sum("count").alias("count"))


def byte_symbols(word: str = "pretoken") -> Column:
    """ARRAY<INT> of the UTF-8 bytes of a string column."""
    chars = F.split(F.decode(F.encode(F.col(word), "UTF-8"), "ISO-8859-1"), "")
    return F.when(F.col(word) == "", F.array().cast("array<int>")).otherwise(F.transform(chars, F.ascii))


def byte_ranks() -> list[int]:
    """The order of bytes by the characters that stand for them in vocabulary files."""
    order = sorted(unicode_bytes().items())
    ranks = [0] * 256
    for k, (_, b) in enumerate(order):
        ranks[b] = k
    return ranks


class TieBreak:
    """Of pairs that are as frequent, the one of the least key is merged."""

    def __init__(self, rule: str, tokens: list[bytes]):
        if rule not in TIES:
            raise ValueError(f"tie_breaking is one of {', '.join(TIES)}, not {rule!r}")
        self.rule, self.tokens, self.ranks = rule, tokens, byte_ranks()

    def rank(self, i: int) -> int:
        return self.ranks[i] if self.rule == "huggingface" and i < 256 else i

    def key(self, a: int, b: int) -> tuple:
        if self.rule == "assembled_bytes":
            return self.tokens[a], self.tokens[b], a, b
        return self.rank(a), self.rank(b)


@dataclass
class Trained:
    """vocab: bytes by id; merges: in order; stages: seconds of each."""

    tokens: list[bytes]
    merges: list[tuple[bytes, bytes]]
    specials: list[str]
    scheme: str
    transition: int | None = None
    timings: dict[str, float] = field(default_factory=dict)

    @property
    def vocab(self) -> dict[int, bytes]:
        return dict(enumerate(self.tokens))

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(self.tokens)], "id int, token binary")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        first = 256 + len(self.specials)
        return spark.createDataFrame([(k, bytearray(a), bytearray(b), first + k) for k, (a, b) in enumerate(self.merges)], "rank int, left binary, right binary, merged_id int")

    def model(self) -> ByteModel:
        """A two-stage vocabulary's texts are one word each."""
        special = {256 + k for k in range(len(self.specials))}
        index = {t: i for i, t in reversed(list(enumerate(self.tokens))) if i not in special}
        pairs = {}
        for k, (a, b) in enumerate(self.merges):
            pairs.setdefault((index[a], index[b]), (k, index[a + b]))
        scheme = SCHEMES["superword"] if self.transition is not None and self.transition < len(self.tokens) else by_name(self.scheme)
        added = tuple(AddedToken(s, 256 + k) for k, s in enumerate(self.specials))
        return ByteModel(tokens=tuple(self.tokens), pairs=PairTable.of(pairs), merges=tuple(self.merges), added=added, scheme=scheme, byte_ids=tuple(range(256)))

    def to_json(self) -> dict:
        """A tokenizer.json."""
        table = bytes_unicode()
        show = lambda t: "".join(table[b] for b in t)
        scheme = self.model().scheme
        if scheme.whole:
            pre = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        elif scheme.name == "gpt2":
            pre = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        else:
            steps = [{"type": "Split", "pattern": {"Regex": p}, "behavior": "Isolated", "invert": False} for p in scheme.patterns]
            pre = {"type": "Sequence", "pretokenizers": [*steps, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        added = [{"id": 256 + k, "content": s, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for k, s in enumerate(self.specials)]
        special = {256 + k for k in range(len(self.specials))}
        vocab: dict[str, int] = {}
        for i, t in enumerate(self.tokens):
            vocab.setdefault(self.specials[i - 256] if i in special else show(t), i)
        model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [[show(a), show(b)] for a, b in self.merges]}
        parts = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": pre}
        return parts | {"post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, "model": model}

    def save(self, path: str | os.PathLike) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_json(), f, ensure_ascii=False)


def linked(n: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next and previous places of ``n`` symbols within words of these lengths; -1 where there is none."""
    at = np.arange(n, dtype=np.int32)
    nxt, prv = at + 1, at - 1
    ends = ends_of(lengths)
    full = np.asarray(lengths) > 0
    nxt[ends[1:][full] - 1] = -1
    prv[ends[:-1][full]] = -1
    return nxt, prv


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the weights of each."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)


def pair_places(noted: list[np.ndarray], sym: np.ndarray, nxt: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the left and the right symbol of a pair, out of those noted, that still hold it and don't overlap."""
    pos = np.unique(np.concatenate(noted)) if noted else np.zeros(0, np.int32)
    pos = pos[sym[pos] == a]
    right = nxt[pos]
    ok = right >= 0
    ok[ok] = sym[right[ok]] == b
    pos, right = pos[ok], right[ok]
    if a == b and len(pos) > 1:  # greedy from the left of each run
        joined = np.concatenate([[False], nxt[pos[:-1]] == pos[1:]])
        k = np.arange(len(pos))
        start = np.maximum.accumulate(np.where(joined, 0, k))
        pos = pos[(k - start) % 2 == 0]
        right = nxt[pos]
    return pos, right


class PairCounts:
    """How often each pair occurs, and which is merged next."""

    def __init__(self, tokens: list[bytes], rule: str):
        self.tokens, self.tie = tokens, TieBreak(rule, tokens)
        self.count: dict[int, int] = {}
        self.heap: list = []

    def change(self, keys: np.ndarray, totals: np.ndarray) -> None:
        for key, total in zip(keys.tolist(), totals.tolist()):
            self.count[key] = now = self.count.get(key, 0) + total
            if now > 0:
                heapq.heappush(self.heap, (-now, self.tie.key(key >> 32, key & 0xFFFFFFFF), key))

    def best(self) -> int | None:
        while self.heap:
            n, _, key = self.heap[0]
            if self.count.get(key, 0) == -n:
                return key
            heapq.heappop(self.heap)
        return None


class MergeLoop(PairCounts):
    """Words as one linked list of symbols, with the places of each pair; a merge touches its neighbours alone."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, counts: np.ndarray, tokens: list[bytes], rule: str):
        super().__init__(tokens, rule)
        self.sym = np.array(symbols, np.int32)
        n = len(self.sym)
        if n >= 1 << 31:
            raise ValueError("too many symbols for one driver; train with where='table'")
        self.nxt, self.prv = linked(n, lengths)
        self.weight = np.repeat(np.asarray(counts, np.int64), lengths)
        self.places: dict[int, list[np.ndarray]] = {}
        self.enter(np.flatnonzero(self.nxt >= 0).astype(np.int32))

    def keys(self, pos: np.ndarray) -> np.ndarray:
        return (self.sym[pos].astype(np.int64) << 32) | self.sym[self.nxt[pos]]

    def add(self, keys: np.ndarray, weights: np.ndarray, sign: int) -> None:
        keys, totals = summed(keys, weights)
        self.change(keys, sign * totals)

    def enter(self, pos: np.ndarray) -> None:
        if not len(pos):
            return
        keys = self.keys(pos)
        order = np.argsort(keys, kind="stable")
        pos, sorted_ = pos[order], keys[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        for key, part in zip(sorted_[first].tolist(), np.split(pos, first[1:])):
            self.places.setdefault(key, []).append(part)
        self.add(sorted_, self.weight[pos], 1)

    def merge(self, key: int, new: int) -> None:
        a, b = key >> 32, key & 0xFFFFFFFF
        pos, right = pair_places(self.places.pop(key, []), self.sym, self.nxt, a, b)
        before, after = self.prv[pos], self.nxt[right]
        touched = np.unique(np.concatenate([before[before >= 0], pos, right[after >= 0]]))
        self.add(self.keys(touched), self.weight[touched], -1)
        self.sym[pos], self.sym[right] = new, -1
        self.nxt[pos] = after
        inner = after >= 0
        self.prv[after[inner]] = pos[inner]
        before = self.prv[pos]  # may have been merged itself
        self.enter(np.unique(np.concatenate([before[before >= 0], pos[inner]])))
        self.count.pop(key, None)

    def run(self, size: int) -> Iterator[tuple[int, int]]:
        """Merges until there are ``size`` tokens, or no pair is left that occurs."""
        while len(self.tokens) < size:
            key = self.best()
            if key is None:
                return
            a, b = key >> 32, key & 0xFFFFFFFF
            self.tokens.append(self.tokens[a] + self.tokens[b])
            self.merge(key, len(self.tokens) - 1)
            yield a, b

    def foresee(self, exact: PairCounts, size: int) -> list[tuple[int, int]]:
        """The merges that would follow by the counts of ``exact`` if these changed as they do here. Nothing here is changed."""
        other = object.__new__(MergeLoop)
        PairCounts.__init__(other, exact.tokens.copy(), exact.tie.rule)
        other.sym, other.nxt, other.prv, other.weight = self.sym.copy(), self.nxt.copy(), self.prv.copy(), self.weight
        other.places = {k: v.copy() for k, v in self.places.items()}
        other.change(np.fromiter(exact.count.keys(), np.int64), np.fromiter(exact.count.values(), np.int64))
        return list(other.run(size))


def flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.array([len(w) for w in words], np.int64)


def changes(sym: np.ndarray, lengths: np.ndarray, counts: np.ndarray, merges: list[tuple[int, int]], first: int, done: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, totals): by how much each merge from ``done`` on changes the count of each pair, in these words.

    Merge k makes the symbol ``first`` + k. A key is (k - done, left, right) in the base of the number of symbols.
    """
    top = first + len(merges)
    table = PairTable.of({pair: (k, k) for k, pair in enumerate(merges)})
    dense = None
    if top * top <= 1 << 20:
        dense = np.full(top * top, -1, np.int32)
        for k, (a, b) in enumerate(merges):
            dense[a * top + b] = k
    sym = np.array(sym, np.int32)
    nxt, prv = linked(len(sym), lengths)
    weight = np.repeat(counts, lengths)
    index: list[list[np.ndarray]] = [[] for _ in merges]
    keys, totals = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def enter(pos: np.ndarray, done: int = -1) -> None:
        left, right = sym[pos], sym[nxt[pos]]
        if dense is not None:
            rank = dense[left.astype(np.int64) * top + right]
        else:
            rank = table.find(left, right)
            rank = np.where(rank >= 0, table.ranks[rank], -1) if len(table.keys) else rank
        pos, rank = pos[rank > done], rank[rank > done]
        if not len(pos):
            return
        order = np.argsort(rank, kind="stable")
        pos, rank = pos[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for k, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(pos, cuts)):
            index[k].append(part)

    def note(k: int, pos: np.ndarray, sign: int) -> None:
        pairs, n = summed(sym[pos].astype(np.int64) * top + sym[nxt[pos]], weight[pos])
        keys.append(pairs + (k - done) * top * top)
        totals.append(sign * n)

    enter(np.flatnonzero(nxt >= 0).astype(np.int32))
    for k, (a, b) in enumerate(merges):
        pos, right = pair_places(index[k], sym, nxt, a, b)
        index[k] = []
        if not len(pos):
            continue
        before, after = prv[pos], nxt[right]
        if k >= done:
            note(k, np.unique(np.concatenate([before[before >= 0], pos, right[after >= 0]])), -1)
        sym[pos], sym[right] = first + k, -1
        nxt[pos] = after
        inner = after >= 0
        prv[after[inner]] = pos[inner]
        before = prv[pos]  # may have been merged itself
        fresh = np.unique(np.concatenate([before[before >= 0], pos[inner]]))
        if k >= done:
            note(k, fresh, 1)
        enter(fresh, k)
    return summed(np.concatenate(keys), np.concatenate(totals))


def symbols_of(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols, lengths and counts of the words of (word BINARY or ARRAY<INT>, count), or of what packed_units makes."""
    if b.num_columns > 2:
        for symbols, n, width, lengths, m in zip(*(c.to_pylist() for c in b.columns)):
            yield np.frombuffer(pa.decompress(symbols, n * width, "zstd"), f"u{width}").astype(np.int32), np.frombuffer(pa.decompress(lengths, 4 * m, "zstd"), np.int32).astype(np.int64), np.ones(m, np.int64)
    elif b.num_rows:
        col = b.column(0)
        if pa.types.is_list(col.type):
            off = col.offsets.to_numpy()
            sym = col.values.to_numpy()[off[0] : off[-1]]
        else:
            off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
            sym = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].astype(np.int32)
        yield sym, np.diff(off).astype(np.int64), b.column(1).to_numpy().astype(np.int64)


def symbol_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held, size = [], 0
    for b in batches:
        for part in symbols_of(b):
            held.append(part)
            size += len(part[0])
            if size >= CHUNK_SYMBOLS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def totals_of(words: DataFrame, each: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their sums over all chunks of the table, on the driver; a task holds the distinct keys so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for chunk in symbol_chunks(batches):
            more, m = each(*chunk)
            keys, n = summed(np.concatenate([keys, more]), np.concatenate([n, m]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    got = words.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n <> 0").toArrow()
    return got.column(0).to_numpy(), got.column(1).to_numpy()


SHARES = 48


def first_totals(sym: np.ndarray, lengths: np.ndarray, counts: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of pairs by left * top + right; at -1 - k the symbols of a sample in which a word of count c has the chance c / 2^k."""
    nxt, _ = linked(len(sym), lengths)
    pos = np.flatnonzero(nxt >= 0)
    keys, n = summed(sym[pos].astype(np.int64) * top + sym[pos + 1], np.repeat(counts, lengths)[pos])
    shares = [int((lengths * np.minimum(1, counts * 2.0**-k)).sum()) for k in range(SHARES)]
    return np.concatenate([-1 - np.arange(SHARES), keys]), np.concatenate([np.array(shares, np.int64), n])


def sample_of(words: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Such a sample, with counts that make up for the words left out. Merges are only foreseen by it: their counts are of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = np.random.default_rng(k)
        for sym, lengths, counts in symbol_chunks(batches):
            taken = np.flatnonzero(chance.random(len(counts)) < counts * 2.0**-k)
            ids = sym[spread(ends_of(lengths)[taken], lengths[taken])]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int32), lengths[taken], np.maximum(counts[taken], 1 << k))], names=["s", "l", "c"])

    got = words.mapInArrow(run, "s binary, l binary, c binary").toArrow()
    return tuple(np.frombuffer(b"".join(got.column(i).to_pylist()), kind) for i, kind in enumerate((np.int32, np.int64, np.int64)))


def merges_over_table(words: DataFrame, tokens: list[bytes], size: int, rule: str) -> Iterator[tuple[int, int]]:
    """The same merges where the words stay partitioned: (word BINARY or symbols ARRAY<INT>, count LONG), or packed units.

    The driver has the count of each pair and a sample of the words. By these it foresees merges; a pass over the
    table then makes them in turn and gives, summed up, by how much each changes the count of each pair. With that
    the driver takes the foreseen merges as long as each is the one that the counts of all words ask for, and foresees
    anew from the first that isn't. The table is written once, and read once a pass.
    """
    from .checkpoint import cut

    words = cut(words)
    first = len(tokens)
    exact = PairCounts(tokens, rule)
    keys, n = totals_of(words, lambda s, w, c: first_totals(s, w, c, first))
    exact.change(((keys // first) << 32 | keys % first)[keys >= 0], n[keys >= 0])
    sizes = dict(zip(keys[keys < 0].tolist(), n[keys < 0].tolist()))
    loop = MergeLoop(*sample_of(words, next((k for k in range(SHARES) if sizes.get(-1 - k, 0) <= SAMPLE_BYTES), SHARES - 1)), tokens.copy(), rule)
    made: list[tuple[int, int]] = []
    ahead = AHEAD
    while len(tokens) < size:
        merges = made + loop.foresee(exact, min(size, len(tokens) + ahead))
        done, top = len(made), first + len(merges)
        if len(merges) == done:
            return
        keys, n = totals_of(words, lambda s, w, c, m=merges, d=done: changes(s, w, c, m, first, d))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        ends = np.searchsorted(keys, np.arange(len(merges) - done + 1) * top * top)
        for step, (a, b) in enumerate(merges[done:]):
            key = a << 32 | b
            if exact.best() != key:
                break
            tokens.append(tokens[a] + tokens[b])
            pairs = keys[ends[step] : ends[step + 1]] % (top * top)
            exact.change((pairs // top) << 32 | pairs % top, n[ends[step] : ends[step + 1]])
            exact.count.pop(key, None)
            loop.tokens.append(tokens[-1])
            loop.merge(key, len(tokens) - 1)
            made.append((a, b))
            yield a, b
        ahead = min(AHEAD, max(16, 2 * (len(made) - done)))


def packed_units(docs: DataFrame, max_bytes: int, model: ByteModel) -> DataFrame:
    """The units of unit_counts, each as often as it occurs, encoded by the first stage's model: compressed, many to a row, and not shuffled."""
    from .encode import parts, short_batches

    short_batches(docs.sparkSession)
    n = max(1, max_bytes)
    cut_up = re.compile(rb"[^\n]{1,%d}(?![\x80-\xBF])|[^\n]{1,%d}" % (n, n)).findall
    # no merge reaches from anything but white space to a space: what lies between such places recurs, and is encoded once
    apart = not any(b[:1] == b" " and a[-1:].strip() for a, b in model.merges)
    split = re.compile(r"(?s)(?=.)\s*\S*(?:[^\S ]\s*\S*)*" if apart else "(?s).+").findall
    held = docs.sparkSession.sparkContext.broadcast(replace(model, added=()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole):
                units = [u.decode("utf-8", "surrogateescape") for t in b.column(0).to_pylist() for u in cut_up(t)]
                ids, lengths = held.value.cache.encode([split(u) for u in units])
                width = 2 if len(held.value.tokens) <= 1 << 16 else 4
                row = [[pa.compress(ids.astype(f"u{width}").tobytes(), "zstd", asbytes=True)], [len(ids)], [width], [pa.compress(lengths.astype(np.int32).tobytes(), "zstd", asbytes=True)], [len(lengths)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32()))], names=["symbols", "n", "width", "lengths", "m"])

    return docs.select(F.encode("text", "UTF-8").alias("t")).mapInArrow(run, "symbols binary, n int, width int, lengths binary, m int")


def corpus(spark: SparkSession, data, separator: str | bytes | None) -> DataFrame:
    """Documents of a DataFrame with a text column, a source, paths, or texts in memory."""
    if isinstance(data, DataFrame):
        docs = data
    elif isinstance(data, (bytes, bytearray, str)) and not (isinstance(data, str) and os.path.exists(data)):
        from ..sources.readers import BytesSource

        docs = BytesSource(data).training_documents(spark)
    elif isinstance(data, Source):
        docs = data.training_documents(spark)
    else:
        docs = as_documents(spark, resolve(data))
    sep = as_separator(separator)
    docs = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    return docs.select(F.explode(split_documents("text", sep)).alias("text")) if sep else docs


def start(specials: Sequence[str]) -> list[bytes]:
    if len(set(specials)) < len(specials):
        raise ValueError("a special token is given twice")
    return [bytes([b]) for b in range(256)] + [s.encode() for s in specials]


def collect_counts(counts: DataFrame, col: str, codec: str) -> tuple[list[bytes], list[int]]:
    rows = counts.select(col, "count").toArrow().sort_by(col)
    return [w.encode(codec) for w in rows.column(0).to_pylist()], rows.column(1).to_pylist()


def run_stage(counts: DataFrame, tokens: list[bytes], size: int, rule: str, model: ByteModel | None, col: str, codec: str) -> list[tuple[int, int]]:
    """One stage's merges on the driver, of (col, count)."""
    words, n = collect_counts(counts, col, codec)
    if model is None:
        symbols, lengths = flat(words)
    else:
        symbols, lengths = merge_words(*flat(words), model.pairs, model.lookup)
    return list(MergeLoop(symbols, lengths, np.array(n, np.int64), tokens, rule).run(size))


def placed(where: str, small: Callable[[], bool]) -> str:
    """``where``: driver, table, or auto (the driver if ``small``)."""
    if where not in ("auto", "driver", "table"):
        raise ValueError(f"where is 'auto', 'driver' or 'table', not {where!r}")
    return where if where != "auto" else "driver" if small() else "table"


def sum_of_bytes(df: DataFrame, col: str) -> int:
    return df.agg(F.sum(F.octet_length(col))).first()[0] or 0


def train_bpe(
    data,
    vocab_size: int,
    special_tokens: Sequence[str] = (),
    tie_breaking: str = "huggingface",
    separator: str | bytes | None = None,
    pretokenizer: str = "gpt2",
    spark: SparkSession | None = None,
    text_col: str = "text",
    where: str = "auto",
    driver_bytes: int = DRIVER_BYTES,
) -> Trained:
    """Ids 0-255 are the bytes, then the special tokens as given, then merges, up to ``vocab_size`` ids.

    ``data``: a DataFrame, a source, paths, or text. Of equally frequent pairs ``tie_breaking`` decides, so that the
    result doesn't depend on the partitioning. Special tokens are not looked for in the corpus. Training ends
    early when no pair occurs any more. Distinct pretokens of up to ``driver_bytes`` bytes are merged on the driver, more in a table; the merges are the same.
    """
    spark = data.sparkSession if isinstance(data, DataFrame) else spark or SparkSession.active()
    docs = corpus(spark, data.select(F.col(text_col).alias("text")) if isinstance(data, DataFrame) else data, separator)
    scheme = by_name(pretokenizer)
    tokens = start(special_tokens)
    TieBreak(tie_breaking, tokens)
    began = time.time()
    counts = pretoken_counts(docs, scheme)
    if where == "auto":
        from .checkpoint import cut

        counts = cut(counts)
    if placed(where, lambda: sum_of_bytes(counts, "pretoken") <= driver_bytes) == "driver":
        merges = run_stage(counts, tokens, vocab_size, tie_breaking, None, "pretoken", "utf-8")
    else:
        merges = list(merges_over_table(counts.select(F.encode("pretoken", "UTF-8").alias("word"), "count"), tokens, vocab_size, tie_breaking))
    return Trained(tokens, [(tokens[a], tokens[b]) for a, b in merges], list(special_tokens), scheme.name, timings={"stage1": time.time() - began})


def train_superbpe(
    data,
    vocab_size: int,
    transition_point: int,
    special_tokens: Sequence[str] = (),
    tie_breaking: str = "huggingface",
    separator: str | bytes | None = SEPARATOR,
    max_unit_len: int = 128,
    pretokenizer: str = "gpt2",
    spark: SparkSession | None = None,
    text_col: str = "text",
    where: str = "auto",
    driver_bytes: int = DRIVER_BYTES,
    timings: dict | None = None,
) -> Trained:
    """Up to ``transition_point`` ids as train_bpe; from there on merges may cross white space.

    In the second stage words are lines, cut into pieces of ``max_unit_len`` bytes, and start as the first
    stage encodes them. Texts of up to ``driver_bytes`` bytes in all are merged on the driver.
    """
    if transition_point > vocab_size:
        raise ValueError(f"transition_point {transition_point} is beyond vocab_size {vocab_size}")
    spark = data.sparkSession if isinstance(data, DataFrame) else spark or SparkSession.active()
    docs = corpus(spark, data.select(F.col(text_col).alias("text")) if isinstance(data, DataFrame) else data, separator)
    first = train_bpe(docs, transition_point, special_tokens, tie_breaking, None, pretokenizer, where=where, driver_bytes=driver_bytes)
    began = time.time()
    tokens = first.tokens
    merges = []
    if vocab_size > len(tokens):
        if placed(where, lambda: sum_of_bytes(docs, "text") <= driver_bytes) == "driver":
            merges = run_stage(unit_counts(docs, max_unit_len), tokens, vocab_size, tie_breaking, first.model(), "unit", "latin-1")
        else:
            merges = list(merges_over_table(packed_units(docs, max_unit_len, first.model()), tokens, vocab_size, tie_breaking))
    out = Trained(tokens, first.merges + [(tokens[a], tokens[b]) for a, b in merges], list(special_tokens), first.scheme, transition_point, first.timings | {"stage2": time.time() - began})
    if timings is not None:
        timings.update(out.timings)
    return out
