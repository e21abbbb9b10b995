"""Suffix-array dedup by longest-previous-factor arrays.

The corpus is the rows' texts in the order of their ids. A word whose following
``min_words`` words occur earlier, in an earlier text or earlier in its own,
starts a later copy; what later copies cover is removed, and the first stays.

Whether the words occur earlier is read off a longest-previous-factor array: in
suffix order, the nearest suffixes on either side that begin at a smaller
position (previous and next smaller position) hold the longest earlier match.

A suffix array over the whole corpus is never needed in one place. Each window
of ``min_words`` words belongs to the least hash of its runs of ``GRAM`` words.
Equal windows have equal least hashes, so suffixes that share a prefix of
``min_words`` words meet in one bucket, and a bucket's array decides about
them exactly. Only buckets that can hold an equal pair are given their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, fresh, narrow, offsets, ragged

MIN_WORDS = 50
GRAM = 8
ARRAY_WORDS = 500_000
SPACES = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@lru_cache(maxsize=1)
def space_codes() -> np.ndarray:
    lut = np.zeros(0x110000, bool)
    lut[SPACES] = True
    return lut


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (characters of its text) of each word; the number of words of each text."""
    lengths = np.array([len(t or "") + 1 for t in texts], np.int64)
    raw = np.frombuffer("\n".join([t or "" for t in texts] + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    full = ~space_codes()[raw]
    edge = np.diff(np.concatenate([[False], full, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_at = offsets(lengths)
    owner = np.searchsorted(text_at, begin, "right") - 1
    n = np.bincount(owner, minlength=len(texts)) if len(begin) else np.zeros(len(texts), np.int64)
    size = end - begin
    chars = raw[full].astype(np.uint64) + np.uint64(1)
    place = ragged(np.zeros(len(size), np.int64), size)
    power = powers(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15)
    h = np.add.reduceat(mixed(chars) * power[place], offsets(size)[:-1]) if len(size) else np.zeros(0, np.uint64)
    return mixed(h + size.astype(np.uint64)), begin - text_at[owner], end - text_at[owner], n


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[i : i + w] for each i that has so many."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:]) if len(x) > span else x[:0]
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if len(x) > w - span else x[:0]


def segments(hashes: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text with one least hash: the hash, the first window and the window after the last, and
    whether the hash occurs twice or more in the run, as it does where two of its windows are equal."""
    if len(hashes) < min_words:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(bool)
    m = len(hashes) - gram + 1
    grams = np.zeros(m, np.uint64)
    for k, p in enumerate(powers(gram, 0xD1342543DE82EF95)):
        grams += hashes[k : k + m] * p
    grams = mixed(grams)
    reach = min_words - gram + 1
    least = window_min(grams, reach)
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.append(begin[1:], len(least))
    order = np.argsort(grams, kind="stable")
    place = np.arange(m)
    lo, hi = np.searchsorted(grams[order], least[begin], "left"), np.searchsorted(grams[order], least[begin], "right")
    rank = np.repeat(np.arange(len(begin)), hi - lo)
    at = place[order][ragged(lo, hi - lo)]
    inside = (at >= begin[rank]) & (at < end[rank] + reach - 1)
    return least[begin].view(np.int64), begin, end, np.bincount(rank[inside], minlength=len(begin)) > 1


def by_text(texts: list[str | None]) -> Iterator[np.ndarray]:
    h, _, _, n = words_of(texts)
    yield from np.split(h, np.cumsum(n)[:-1]) if len(texts) else ()


def suffix_ranks(tokens: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """By prefix doubling: ranks of the suffixes, cut at ``ends``, by their first 1, 2, 4, ... words; the last by all."""
    left = ends - np.arange(len(tokens))
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    ranks, span = [rank], 1
    while span < left.max():
        more = np.zeros(len(rank), np.int64)
        inside = np.flatnonzero(left > span)
        more[inside] = rank[inside + span]
        rank = np.unique(rank * (int(rank.max()) + 1) + more, return_inverse=True)[1].astype(np.int64) + 1
        ranks.append(rank)
        span *= 2
    return ranks


def common_prefix(i: np.ndarray, j: np.ndarray, ends: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """The number of words that the suffixes i and j have in common."""
    total = np.zeros(len(i), np.int64)
    end_i, end_j = ends[i], ends[j]
    for level in reversed(range(len(ranks))):
        span = 1 << level
        inside = np.flatnonzero((i + total + span <= end_i) & (j + total + span <= end_j))
        same = inside[ranks[level][i[inside] + total[inside]] == ranks[level][j[inside] + total[inside]]]
        total[same] += span
    return total


def smaller_before(pos: np.ndarray) -> np.ndarray:
    """For each i the nearest k < i with pos[k] < pos[i], or -1, by pointer jumping."""
    held = np.concatenate([[-1], pos])
    at = np.arange(len(pos), dtype=np.int64)  # shifted by one: 0 is the sentinel
    jump = np.concatenate([[0], at])
    todo = np.arange(1, len(held))
    while len(todo):
        todo = todo[held[jump[todo]] >= held[todo]]
        jump[todo] = jump[jump[todo]]
    return jump[1:] - 1


def longest_previous(tokens: np.ndarray, ends: np.ndarray, own: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes ``own`` (rising): the longest previous factor among them, and where it occurs (-1: nowhere).

    Lengths under ``min_words`` may be given as 0.
    """
    ranks = suffix_ranks(tokens, ends)
    order = own[np.argsort(ranks[-1][own], kind="stable")]
    # only neighbours with a long common prefix can be a match: others are left out at once
    close = common_prefix(order[:-1], order[1:], ends, ranks) >= min_words
    kept = np.concatenate([[False], close]) | np.concatenate([close, [False]])
    sa = order[kept]
    length, source = np.zeros(len(tokens), np.int64), np.full(len(tokens), -1, np.int64)
    if len(sa):
        psv = smaller_before(sa)
        nsv = len(sa) - 1 - smaller_before(sa[::-1])[::-1]
        for other, none in ((psv, -1), (nsv, len(sa))):
            has = np.flatnonzero(other != none)
            lcp = common_prefix(sa[has], sa[other[has]], ends, ranks)
            better = lcp > length[sa[has]]
            length[sa[has[better]]] = lcp[better]
            source[sa[has[better]]] = sa[other[has[better]]]
    short = length < min_words
    length[short], source[short] = 0, -1
    return length[own], source[own]


def row_spans(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(z, i, th, copy, start_word, end_word, sources): see ``later_copies``. A row is named by z (its id is null), i (its id),
    th (a hash of its text) and copy, which numbers the rows of one id and text from 0."""
    if min_words < GRAM:
        raise ValueError(f"min_words is {GRAM} at least")
    spark = docs.sparkSession
    gram, parts = GRAM, int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = narrow(docs, id_col, text_col).filter("text is not null").select(F.col("id").isNull().alias("z"), F.coalesce("id", F.lit(0)).alias("i"), F.xxhash64("text").alias("th"), "text")
    name = ["z", "i", "th"]

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, 4 << 20):
            found = [segments(h, min_words, gram) for h in by_text(t.column("text").to_pylist())]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            cols = [np.concatenate([f[k] for f in found]) for k in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *(t.column(c).combine_chunks().take(rows) for c in name), pa.array(cols[1].astype(np.int32)), pa.array(cols[2])], names=["h", *name, "s", "twice"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, 4 << 20):
            heads, n = t.column("heads").to_pylist(), t.column("n").to_pylist()
            out: list[list] = [[] for _ in range(5)]
            for row, (h, at) in enumerate(zip(by_text(t.column("text").to_pylist()), heads)):
                least, begin, end, _ = segments(h, min_words, gram)
                words = h.astype(np.uint32)  # 32 bits of each word
                for k in np.flatnonzero(np.isin(begin, at)).tolist():
                    for c, v in zip(out, (row, int(least[k]), int(begin[k]), 0, words[begin[k] : end[k] + min_words - 1].tobytes())):
                        c.append(v)
                if n[row] > 1:  # the same row again: all of it is a copy
                    for c, v in zip(out, (row, int(h[0].view(np.int64)), len(h), n[row] - 1, b"")):
                        c.append(v)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out[1], pa.int64()), *(t.column(c).combine_chunks().take(rows) for c in name), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=["h", *name, "s", "again", "words"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*name, "copy", "start_word", "end_word", "source"]
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        bucket, first = None, {}
        owner: list[tuple] = []
        at: list[int] = []
        held: list[bytes] = []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = zip(*found) if found else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

        def source_id(o: tuple) -> int | None:
            return None if o[0] else o[1]

        def arrays() -> pa.RecordBatch:
            size = np.array([len(x) // 4 for x in held], np.int64)
            tokens = np.frombuffer(b"".join(held), np.uint32)
            starts = offsets(size)
            own = ragged(starts[:-1], size - (min_words - 1))
            length, source = longest_previous(tokens, np.repeat(starts[1:], size), own, min_words)
            hit = np.flatnonzero(length)
            if not len(hit):
                return rows([])
            p, q = own[hit], source[hit]
            seg, src = np.searchsorted(starts, p, "right") - 1, np.searchsorted(starts, q, "right") - 1
            word = np.array(at)[seg] + p - starts[seg]
            new = np.ones(len(p), bool)
            new[1:] = (seg[1:] != seg[:-1]) | (np.diff(p) != 1) | (src[1:] != src[:-1])
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(p)) - 1
            return rows([(*owner[a], 0, s, e, source_id(owner[b])) for a, b, s, e in zip(seg[begin].tolist(), src[begin].tolist(), word[begin].tolist(), (word[last] + min_words).tolist())])

        for b in batches:
            same: list[tuple] = []
            for h, z, i, th, s, again, w in zip(*(b.column(c).to_pylist() for c in ("h", *name, "s", "again", "words"))):
                if again:
                    for k in range(1, again + 1):
                        same.append((z, i, th, k, 0, s, source_id((z, i))))
                        if len(same) >= 100_000:
                            yield rows(same)
                            same = []
                    continue
                if h != bucket:
                    if sum(map(len, held)) > 4 * ARRAY_WORDS:
                        yield arrays()
                        owner, at, held = [], [], []
                    bucket, first = h, {}
                key = hashlib.blake2b(w, digest_size=16).digest()
                if key in first:  # a copy of a whole segment of this bucket needs no sorting
                    same.append((z, i, th, 0, s, s + len(w) // 4, source_id(first[key])))
                else:
                    first[key] = (z, i)
                    owner.append((z, i, th))
                    at.append(s)
                    held.append(w)
            if same:
                yield rows(same)
        if held:
            yield arrays()

    kind = "z boolean, i long, th long"
    # a bucket matters if it has two segments, or one in which its least run of words occurs twice
    segs = cut(texts.mapInArrow(buckets, f"h long, {kind}, s int, twice boolean"))
    many = segs.groupBy("h").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).filter("n > 1 or twice").select("h")
    heads = segs.join(many, "h", "left_semi").groupBy(*name).agg(F.collect_set("s").alias("heads"))
    joined = texts.join(heads, name).groupBy(*name).agg(F.min("text").alias("text"), F.first("heads").alias("heads"), F.count("*").alias("n"))
    expanded = joined.mapInArrow(expand, f"h long, {kind}, s int, again long, words binary").repartition(parts, "h")
    found = expanded.sortWithinPartitions("h", *name, "s").mapInArrow(match, f"{kind}, copy long, start_word int, end_word int, source long")
    row = [*name, "copy"]
    order = Window.partitionBy(*row).orderBy("start_word", "end_word").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("start_word") > F.coalesce(F.max("end_word").over(order), F.lit(-1)), 1).otherwise(0)
    island = F.sum("new").over(Window.partitionBy(*row).orderBy("start_word", "end_word").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("new", new).withColumn("island", island).groupBy(*row, "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.sort_array(F.collect_set("source")).alias("sources")).drop("island")


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, start_word, end_word, source_doc_ids): the maximal runs of words that later copies cover, row by row.

    Words are what white space separates, numbered from 0; end_word is not covered. source_doc_ids:
    the ids that hold the earlier matches, rising, null ones left out. A text of less than ``min_words``
    words, an empty or null one has no rows. Rows are taken in the order of their ids, null last, those of one id
    by a hash of their texts; of rows with the same id and text all but one are copies as a whole. Matches are
    exact in case and punctuation, and may lie within one text and overlap. Ids are cast to LONG.
    """
    spans = row_spans(docs, id_col, text_col, min_words)
    return spans.select(F.when(~F.col("z"), F.col("i")).alias(id_col), "start_word", "end_word", F.col("sources").alias("source_doc_ids"))


def remove_later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the words of later copies cut out of the text, with the white space before each cut.

    Rows and their order are those of ``later_copies``. A text that is a copy as a whole becomes empty; a row
    never goes. All other columns stay as they are. Null and empty texts stay. Of rows with the same id and text
    the one that keeps its text is the least by its other columns (maps and variants aside).
    """
    z, i, th, cuts_, place = fresh(docs, "z", "i", "th", "cuts", "place")
    spans = row_spans(docs, id_col, text_col, min_words).groupBy("z", "i", "th", "copy").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts"))
    by_copy = spans.groupBy(F.col("z").alias(z), F.col("i").alias(i), F.col("th").alias(th)).agg(F.map_from_entries(F.collect_list(F.struct("copy", "cuts"))).alias(cuts_))

    @F.pandas_udf("string")
    def without(text, cuts):
        import pandas as pd

        out = []
        for t, spans_ in zip(text, cuts):
            if spans_ is None or t is None:
                out.append(t)
                continue
            _, begin, end, _ = words_of([t])
            kept, at = [], 0
            for s in spans_:
                stop = end[s["start_word"] - 1] if s["start_word"] else 0
                kept.append(t[at:stop])
                at = end[s["end_word"] - 1]
            out.append("".join([*kept, t[at:]]))
        return pd.Series(out, dtype=object)

    keyed = docs.withColumns({z: F.col(id_col).cast("long").isNull(), i: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), th: F.coalesce(F.xxhash64(F.col(text_col).cast("string")), F.lit(0))})
    wide = keyed.join(by_copy, [z, i, th], "left")
    others = [c for c, kind in docs.dtypes if c not in (text_col, id_col) and "map<" not in kind and kind != "variant"]
    wide = wide.withColumn(place, F.row_number().over(Window.partitionBy(z, i, th).orderBy(*[F.col(f"`{c}`") for c in others or [id_col]])).cast("long") - 1)
    own = F.element_at(F.col(cuts_), F.col(place))
    return wide.withColumn(text_col, F.when(own.isNotNull(), without(F.col(text_col), own)).otherwise(F.col(text_col))).select(*docs.columns)
