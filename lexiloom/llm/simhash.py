"""SimHash near-dedup with pivot distance tables.

Each text gets a fingerprint of 256 bits from its words, a word weighing four
times the square root of its count. Equal fingerprints are one entry from then
on. Candidates are entries that agree on all sampled bits of a band. Before any
fingerprint is shuffled, candidates are held against each other by their rows of
a table of distances to reference fingerprints (pivots): by the triangle
inequality a pair whose rows differ anywhere by more than the threshold is
farther apart than it, and is discarded. Fingerprints join the survivors alone,
and verify them.

The pivots are a base fingerprint with any of its 32 bytes inverted, 2**32 of
them. Inverting a byte turns its distance d into 8 - d, so the distances to all
pivots follow from the 32 bytes' distances to the base, and the greatest of the
2**32 differences of two rows is the sum of the absolute differences of these
32. So many pivots are needed: random far pairs of 256 bits lie at nearly equal
distances from any few of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbering, chunks, cut, fresh, if_small, narrow, offsets, ragged

BITS = 256
MAX_DISTANCE = 32
#: Where bands are asked for: bits of a band: the binary logarithm of the entries, BAND_BITS at least. So many bands that a pair at the limit is missed by one in ten.
BAND_BITS, RECALL = 20, 0.9
#: Masks are made for parts of so many wrong bits less one at most; entries of a block; keys that a task sorts at least.
COVER, BLOCK, TASK = 6, 500_000, 2_000_000
SMALL = 48
PAIRS = 400_000
WORDS = re.compile(r"\w+")


def word_bits(words: list[str]) -> np.ndarray:
    """+1 or -1 for each word and bit."""
    if not words:
        return np.zeros((0, BITS), np.int8)
    raw = b"".join(xxhash.xxh3_128_digest(b, seed=s) for b in (w.encode("utf-8", "surrogatepass") for w in words) for s in range(BITS // 128))
    return (np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS).view(np.int8) << 1) - 1


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as 32 bytes each, and which texts have words at all."""
    vocab, at, weight, n = Numbering(), [], [], np.zeros(len(texts), np.int64)
    number = vocab.__getitem__
    for i, t in enumerate(texts):
        c = Counter(WORDS.findall(t.lower())) if t else {}
        n[i] = len(c)
        at.append(np.fromiter(map(number, c), np.int32, len(c)))
        weight.append(np.fromiter(c.values(), np.int64, len(c)))
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    some = n > 0
    if some.any():
        table = word_bits(list(vocab))
        at, weight = np.concatenate(at), np.concatenate(weight)
        weight = np.floor(4 * np.sqrt(weight) + 0.5).astype(np.float32)
        starts = offsets(n)
        step = 0
        while step < len(texts):  # some 20,000 words at a time
            end = max(step + 1, int(np.searchsorted(starts, starts[step] + 20_000, "right")) - 1)
            rows = table[at[starts[step] : starts[end]]].astype(np.float32)  # the sums are whole and exact below 2**24
            w = weight[starts[step] : starts[end]]
            for i in range(step, end):
                if some[i]:
                    part = slice(starts[i] - starts[step], starts[i + 1] - starts[step])
                    out[i] = np.packbits(w[part] @ rows[part] > 0)
            step = end
    return out, some


def band_plan(entries: int, max_distance: int = MAX_DISTANCE, least_bits: int = BAND_BITS, recall: float = RECALL) -> tuple[int, int]:
    """Bands, and bits of each, for so many entries: pairs at ``max_distance`` share a band with a chance of ``recall``."""
    size = min(40, max(least_bits, math.ceil(math.log2(max(entries, 1)))))
    if max_distance > BITS - size:
        raise ValueError(f"max_distance is {BITS - size} at most")
    share = math.prod((BITS - max_distance - k) / (BITS - k) for k in range(size))
    return (1 if share >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - share))), size


def band_bits(bands: int, size: int) -> np.ndarray:
    rng = np.random.default_rng(20_011)
    return np.stack([rng.permutation(BITS)[:size] for _ in range(bands)])


def band_keys(fps: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(fps, axis=1)
    size = chosen.shape[1]
    power = 1 << np.arange(size, dtype=np.int64)
    return np.stack([(k << size) + bits[:, c].astype(np.int64) @ power for k, c in enumerate(chosen)], axis=1)


def base_pivot() -> np.ndarray:
    return np.random.default_rng(77).integers(0, 256, BITS // 8, np.uint8)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of fingerprints as rows of 64-bit numbers."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def pivot_table(fps: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Rows of 32 distances of 0 to 8, two a byte, as two 64-bit numbers: they stand for those to all pivots."""
    d = np.bitwise_count(fps ^ base)
    return np.ascontiguousarray((d[:, ::2] << 4) | d[:, 1::2]).view(np.int64)


def unpacked(table: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(table).view(np.uint8).reshape(len(table), table.shape[1] * 8)
    return np.concatenate([raw >> 4, raw & 15], axis=1).view(np.int8)


def greatest_difference(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The maximum coordinate difference of the pairs' rows over all pivots."""
    return np.abs(rows[i] - rows[j]).sum(1, dtype=np.int16)


def fingerprint_distance(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return hamming(fps[i], fps[j])


def bucket_edges(starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray, limit: int, distance) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each bucket, what pairs within ``limit`` by ``distance`` connect.

    Small buckets give all their pairs; in large ones each found entry is held against those
    not yet found, so that a cluster of n copies takes about n steps. The links are the same.
    """
    a, b = [], []
    small = (sizes > 1) & (sizes <= SMALL)
    s, z = starts[small], sizes[small]
    for lo in range(0, len(s), 4_000):
        ss, zz = s[lo : lo + 4_000], z[lo : lo + 4_000]
        left = ragged(ss, zz)
        many = np.repeat(ss + zz, zz) - left - 1
        i, j = np.repeat(left, many), ragged(left + 1, many)
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            ok = distance(rows, x, y) <= limit
            a.append(x[ok])
            b.append(y[ok])
    for s, z in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        rest, queue = np.arange(s, s + z), []
        while len(rest) or queue:
            if not queue:
                queue, rest = [int(rest[0])], rest[1:]
            u = queue.pop()
            ok = np.concatenate([distance(rows, np.full(len(p), u), p) <= limit for p in np.split(rest, range(PAIRS, len(rest), PAIRS))])
            found, rest = rest[ok], rest[~ok]
            a.append(np.full(len(found), u))
            b.append(found)
            queue += found.tolist()
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that edges connect with each of 0..n-1."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        before = low.copy()
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            break
    return low


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h LONG, fp BINARY) of the rows that have any word; h is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, 8 << 20):
            fps, some = fingerprints(t.column("text").to_pylist())
            keep = np.flatnonzero(some)
            at = pa.py_buffer((np.arange(len(keep) + 1) * (BITS // 8)).astype(np.int32))
            col = pa.Array.from_buffers(pa.binary(), len(keep), [None, at, pa.py_buffer(fps[keep].tobytes())])
            rows = pa.array(keep)
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(rows) for c in ("id", "h")] + [col], names=["id", "h", "fp"])

    return narrow(docs, id_col, text_col).withColumn("h", F.xxhash64("text")).mapInArrow(run, "id long, h long, fp binary")


def whole_buckets(batches: Iterator[pa.RecordBatch], key: str, limit: int = 16 << 20) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, of ``limit`` bytes or as much as the last run takes."""
    held: list[pa.Table] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        size += b.nbytes
        if size < limit:
            continue
        t = pa.concat_tables(held)
        keys = t.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        if last:
            yield t.slice(0, last)
        held, size = [t.slice(last)], t.slice(last).nbytes
    if held:
        yield pa.concat_tables(held)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of runs of two or more equal keys, and these runs' sizes."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(begin, len(keys)))
    many = sizes > 1
    return ragged(begin[many], sizes[many]), sizes[many]


def as_fingerprints(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def near_edges(one: DataFrame, max_distance: int, bands: int, size: int) -> DataFrame:
    """(a, b): links that connect what pairs of entries (node, fp) within ``max_distance`` connect."""
    chosen, base = band_bits(bands, size), base_pivot()
    parts = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, 256 << 10):
            raw = as_fingerprints(t.column("fp"))
            tab = np.repeat(pivot_table(raw, base), bands, axis=0)
            cols = [band_keys(raw, chosen).ravel(), np.repeat(t.column("node").to_numpy(), bands), tab[:, 0], tab[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "t0", "t1"])

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches, "key"):
            rows, sizes = runs(t.column("key").to_numpy())
            tab = unpacked(np.stack([t.column(c).to_numpy()[rows] for c in ("t0", "t1")], axis=1))
            i, j = bucket_edges(offsets(sizes)[:-1], sizes, tab, max_distance, greatest_difference)
            low = labels(len(rows), i, j)
            linked = np.zeros(len(rows), bool)
            linked[i] = linked[j] = True
            node = t.column("node").to_numpy()[rows]
            # a set of entries is named by its members: the same set out of many bands is one
            name = np.zeros(len(rows), np.uint64)
            np.add.at(name, low[linked], mixed(node[linked]))
            yield pa.RecordBatch.from_arrays([pa.array(name[low[linked]].view(np.int64)), pa.array(node[linked])], names=["name", "node"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches, "name"):
            rows, sizes = runs(t.column("name").to_numpy())
            fp = as_fingerprints(t.column("fp").take(pa.array(rows))).view(np.uint64)
            node = t.column("node").to_numpy()[rows]
            i, j = bucket_edges(offsets(sizes)[:-1], sizes, fp, max_distance, fingerprint_distance)
            ab = np.unique(np.stack([node[i], node[j]], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    banded = one.select("node", "fp").mapInArrow(keys, "key long, node long, t0 long, t1 long")
    left = banded.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(survivors, "name long, node long").distinct()
    with_fp = left.join(one.select("node", "fp"), "node").select("name", "node", "fp")
    return with_fp.repartition(parts, "name").sortWithinPartitions("name").mapInArrow(verified, "a long, b long").distinct()


def masks(max_distance: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, mask of these): any two fingerprints within ``max_distance`` agree on all bits of one mask at least.

    The bits are cut into parts. Their shares of wrong bits add up to max_distance + 1 less one for each part, so that one
    part has no more wrong bits than its share t. Each bit of it has a vector of t + 1 bits, and each vector v but 0
    gives the mask of the bits whose vectors have an odd product with v. Up to t wrong bits are as many equations for
    v, which leave one besides 0: its mask has none of the wrong bits. Where the masks would select nothing, one
    empty mask stands for all pairs.
    """
    n = -(-(max_distance + 1) // COVER)
    shares = [(max_distance + 1 + k) // n for k in range(n)]  # t + 1
    if n > BITS:
        return [(0, 1, 0)]
    cuts = [BITS * k // n for k in range(n + 1)]
    rng, out, selected = np.random.default_rng(40_013), [], 0.0
    for lo, hi, share in zip(cuts, cuts[1:], shares):
        width = min(hi - lo, 63)
        vectors = np.concatenate([rng.permutation(np.arange(1, 1 << share)) for _ in range(-(-width // ((1 << share) - 1)))])[:width]
        for v in range(1, 1 << share):
            odd = np.bitwise_count(vectors & v) & 1
            out.append((lo, width, int(odd.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)))))
            selected += 0.5 ** int(odd.sum())
    return out if selected < 0.5 else [(0, 1, 0)]


def part_words(fps: np.ndarray, parts: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The bits of each part (first bit, bits) of fingerprints of 32 bytes, as one number."""
    out = {part: np.zeros(len(fps), np.int64) for part in parts}
    for k in range(0, len(fps), 20_000):
        bits = np.unpackbits(fps[k : k + 20_000], axis=1)
        for lo, width in parts:
            for b in range(width):
                out[lo, width][k : k + 20_000] |= bits[:, lo + b].astype(np.int64) << b
    return out


def cover_edges(fps: np.ndarray, chosen: list[tuple[int, int, int]], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what pairs of fingerprints within ``limit`` that agree on one of the masks connect. What is connected isn't compared again."""
    n = len(fps)
    words, tab, whole = part_words(fps, sorted({m[:2] for m in chosen})), unpacked(pivot_table(fps, base_pivot())), fps.view(np.uint64)
    index, shift, low = np.arange(n, dtype=np.uint64), np.uint64(n.bit_length()), np.arange(n)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def distance(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = rows[x], rows[y]
        out = np.zeros(len(x), np.int16)
        apart = np.flatnonzero(low[x] != low[y])
        out[apart] = greatest_difference(tab, x[apart], y[apart])
        apart = apart[out[apart] <= limit]
        out[apart] = hamming(whole[x[apart]], whole[y[apart]])
        return out

    for lo, width, mask in chosen:
        # hashes and places in one number: what meets by a clash is verified like all others
        keys = np.sort((mixed(words[lo, width] & mask) >> shift << shift) | index)
        at, sizes = runs(keys >> shift)
        rows = (keys[at] & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
        if not len(rows):
            continue
        starts = offsets(sizes)[:-1]
        several = np.minimum.reduceat(low[rows], starts) != np.maximum.reduceat(low[rows], starts)
        rows, sizes = rows[np.repeat(several, sizes)], sizes[several]
        i, j = bucket_edges(offsets(sizes)[:-1], sizes, rows, limit, distance)
        i, j = rows[i], rows[j]
        new = low[i] != low[j]
        if new.any():
            a.append(i[new])
            b.append(j[new])
            low = labels(n, low[i[new]], low[j[new]])[low]
    return np.concatenate(a), np.concatenate(b)


def all_edges(one: DataFrame, entries: int, max_distance: int, block: int = BLOCK, task: int = TASK) -> DataFrame:
    """(a, b): links that connect what pairs of entries (node, fp) within ``max_distance`` connect; none is left out.

    Entries are cut into blocks by hashes, and each two blocks are a task, which has some of the masks where there
    are fewer tasks than cores. An entry is sent to as many tasks as there are blocks: 40 bytes each, in place of
    a row for each of hundreds of masks.
    """
    chosen = masks(max_distance)
    blocks = max(1, -(-entries // block))
    pairs = max(1, blocks * (blocks - 1) // 2)
    rows = entries if blocks == 1 else 2 * block
    shares = max(1, min(len(chosen), rows * len(chosen) // task, -(-2 * one.sparkSession.sparkContext.defaultParallelism // pairs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, fps, share = [], [], 0
        for t in batches:
            if t.num_rows:
                share = t.column("task")[0].as_py() % shares  # a partition is a task
                node.append(t.column("node").to_numpy())
                fps.append(as_fingerprints(t.column("fp")))
        if node:
            node = np.concatenate(node)
            i, j = cover_edges(np.concatenate(fps), chosen[share::shares], max_distance)
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    mine, other = F.pmod(F.xxhash64("node"), F.lit(blocks)), F.col("other")
    high = F.greatest("mine", "other")
    pair = high * (high - 1) / 2 + F.least("mine", "other") if blocks > 1 else F.lit(0)
    sent = one.select("node", "fp", mine.cast("long").alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("other"))
    sent = (sent.filter("mine <> other") if blocks > 1 else sent).select("node", "fp", pair.cast("int").alias("pair"))
    sent = sent.select("node", "fp", F.explode(F.sequence(F.col("pair") * shares, F.col("pair") * shares + (shares - 1))).alias("task"))
    return sent.repartitionById(pairs * shares, F.col("task")).mapInArrow(run, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(id, root): the least id that edges (a, b) connect with each id. By alternating large and small stars."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = cut(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 1_000_033)).first())
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def grouped_texts(docs: DataFrame, id_col: str, text_col: str, max_distance: int, bands: int | None, band_size: int | None) -> DataFrame:
    """(id, h, n, first_id, is_first) of the rows in groups: ``n`` rows of one id and text; the first of a group by id, null last, then by h."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(fingerprint_table(docs, id_col, text_col))
    # numbers of a checkpointed table don't change if it is read again
    one = cut(rows.groupBy("fp").agg(F.count("*").alias("n")).repartition(parts, "fp").withColumn("node", F.monotonically_increasing_id()))
    entries = one.count()
    if bands or band_size:
        n_bands, size = band_plan(entries, max_distance, **({"least_bits": band_size} if band_size else {}))
        edges = near_edges(one, max_distance, bands or n_bands, size)
    else:
        edges = all_edges(one, entries, max_distance)
    roots = connected(edges)
    roots = roots.union(roots.select(F.col("root").alias("id"), "root").distinct())
    members = one.join(roots, one["node"] == roots["id"], "left").filter("root is not null or n > 1").select("fp", F.coalesce("root", "node").alias("g"))
    texts = rows.join(members, "fp").groupBy("g", "id", "h").agg(F.count("*").alias("n"))
    place = F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col("h"))
    firsts = texts.groupBy("g").agg(F.min(place).alias("first"))
    return texts.join(firsts, "g").select("id", "h", "n", F.col("first.id").alias("first_id"), (place == F.col("first")).alias("is_first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE, bands: int | None = None, band_size: int | None = None) -> DataFrame:
    """(id, duplicate_of): for each row of a group but its first, the least id of the group.

    A group is what pairs of texts within ``max_distance`` of 256 bits connect. Every row is a query, and every
    pair within the threshold counts. Only where ``bands`` or ``band_size`` is given, a pair must agree on one of so
    many samples of at least so many bits (see ``band_plan``) and may be missed. Null and empty texts and texts without any
    word are in no group. Rows count by themselves: rows that share an id may be in different groups, or in
    one, of which all but one are listed. A null id is a row's like any other, and comes after all numbers;
    duplicate_of is null where a group has no id at all. Ids are cast to LONG.
    """
    t = grouped_texts(docs, id_col, text_col, max_distance, bands, band_size)
    more = F.col("n") - F.col("is_first").cast("long")
    each = t.filter(more > 0).select("id", "first_id", F.explode(F.sequence(F.lit(1).cast("long"), more)))
    return each.select(F.col("id").alias(id_col), F.col("first_id").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the least id (null last).

    Rows are decided by their texts: of rows that share an id those go that resemble another kept row, and
    others stay. Rows whose text is null, empty or without any word stay. Of rows with the same id and text
    the least by its other columns stays (maps and variants aside). An id that isn't a number fails as a cast does.
    """
    gid, h, row, mark = fresh(docs, "id", "h", "row", "mark")
    t = cut(grouped_texts(docs, id_col, text_col, params.pop("max_distance", MAX_DISTANCE), params.pop("bands", None), params.pop("band_size", None), **params).select(F.col("id").alias(gid), F.col("h").alias(mark), "n", "is_first"))
    keyed = docs.withColumn(h, F.xxhash64(F.col(text_col).cast("string")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(gid)) & (F.col(h) == F.col(mark))
    # what is alone, or first of its group and there once, stays where it is
    left = keyed.join(if_small(t.filter("not is_first or n > 1").select(gid, mark)), same, "left_anti").select(*docs.columns)
    again = keyed.join(if_small(t.filter("is_first and n > 1").select(gid, mark)), same, "left_semi")
    others = [c for c, kind in docs.dtypes if c != text_col and "map<" not in kind and kind != "variant"]
    once = again.groupBy(id_col, h).agg(F.min_by(F.struct(*docs.columns), F.struct(*others)).alias(row)).select(f"{row}.*")
    return left.unionByName(once)
