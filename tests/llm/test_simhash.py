import itertools

import numpy as np

from lexiloom.llm import simhash

from . import brute_force


def corpus():
    rng = np.random.default_rng(3)
    words = [f"word{k}" for k in range(3000)]
    texts = []
    for _ in range(60):
        base = list(rng.choice(words, rng.integers(80, 300)))
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 5)):
            edited = base.copy()
            for k in rng.integers(0, len(base), max(1, len(base) // 30)):
                edited[k] = words[rng.integers(len(words))]
            texts.append(" ".join(edited))
        if rng.random() < 0.4:
            texts.append(texts[-1])
    return texts


def test_equals_all_pairs(spark):
    texts = corpus()
    ids = list(range(100, 100 + len(texts)))
    extra = [(900, None), (901, ""), (902, "?!"), (903, None), (904, "")]
    df = spark.createDataFrame([(i, t, b"x") for i, t in [*zip(ids, texts), *extra]], "doc_id long, text string, fp binary").repartition(4)
    _, want = brute_force.near_groups(ids, texts, simhash.MAX_DISTANCE)
    got = {r["doc_id"]: r["duplicate_of"] for r in simhash.near_duplicates(df).collect()}
    assert len(want) > 50
    same = sum(got.get(i) == j for i, j in want.items())
    assert same >= 0.95 * len(want) and set(got) <= set(want)


def edited_texts(n=350):
    """Texts and a copy of each with so many other words that their distances lie about the limit."""
    rng = np.random.default_rng(12)
    words = [f"word{k}" for k in range(30_000)]
    texts = []
    for k in range(n):
        base = list(rng.choice(words, 100))
        edited = base.copy()
        for at in rng.permutation(100)[: 4 + k % 5]:
            edited[at] = words[rng.integers(len(words))]
        texts += [" ".join(base), " ".join(edited)]
    return texts


def test_no_pair_near_the_limit_is_lost(spark):
    texts = edited_texts()
    pairs, want = brute_force.near_groups(list(range(len(texts))), texts, simhash.MAX_DISTANCE)
    assert 200 < len(pairs) < 340
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["duplicate_of"] for r in simhash.near_duplicates(df).collect()} == want


def test_masks_cover_every_pair_within_the_limit():
    rng = np.random.default_rng(2)
    for limit in (0, 1, 7, 32, 60, 255):
        chosen = simhash.masks(limit)
        fps = rng.integers(0, 256, (400, 32), np.uint8)
        bits = np.unpackbits(fps, axis=1)
        for row in bits:
            row[rng.permutation(256)[:limit]] ^= 1
        both = [simhash.part_words(f, sorted({m[:2] for m in chosen})) for f in (fps, np.packbits(bits, axis=1))]
        met = np.zeros(400, bool)
        for lo, width, mask in chosen:
            met |= (both[0][lo, width] & mask) == (both[1][lo, width] & mask)
        assert met.all()
    assert len(simhash.masks(32)) == 282


def test_blocks_and_shares_of_masks_give_all_groups(spark):
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 256, (600, 32), np.uint8)
    bits = np.unpackbits(fps, axis=1)
    for k in range(300):  # chains, and a star of 100 that differ
        bits[300 + k] = bits[k] if k < 200 else bits[0]
        bits[300 + k, rng.permutation(256)[: 32 if k < 200 else 10]] ^= 1
    fps = np.packbits(bits, axis=1)
    i, j = np.triu_indices(600, 1)
    near = simhash.hamming(fps.view(np.uint64)[i], fps.view(np.uint64)[j]) <= 32
    low = simhash.labels(600, i[near], j[near])
    one = spark.createDataFrame([(k, f.tobytes()) for k, f in enumerate(fps)], "node long, fp binary")
    for block, task in ((1000, 10_000), (150, 1 << 40), (250, 40_000)):
        edges = simhash.all_edges(one, 600, 32, block, task).collect()
        a, b = (np.array([r[c] for r in edges]) for c in "ab")
        assert (simhash.labels(600, a, b) == low).all()
        assert (simhash.hamming(fps.view(np.uint64)[a], fps.view(np.uint64)[b]) <= 32).all()


def test_rows_count_by_themselves(spark):
    near = "one two three four five six seven"
    rows = [(1, near), (1, "quite another text of other words"), (1, near), (2, near.upper()), (None, near), (None, near), (3, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["duplicate_of"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1), (2, 1), (None, 1), (None, 1)]
    kept = [tuple(r) for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, near), (1, rows[1][1]), (3, None), (None, "")], key=str)
    nameless = simhash.near_duplicates(df.filter("doc_id is null")).collect()
    assert [tuple(r) for r in nameless] == [(None, None)]


def test_large_bucket_takes_all():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, (1, 4)).astype(np.uint64)
    fps = np.repeat(base, 200, 0)
    fps[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    far = rng.integers(0, 1 << 63, (20, 4)).astype(np.uint64)
    a, b = simhash.bucket_edges(np.array([0]), np.array([220]), np.concatenate([fps, far]), 8, simhash.fingerprint_distance)
    assert set(a) | set(b) == set(range(200)) and len(a) < 1000


def test_the_greatest_difference_is_that_over_all_pivots():
    rng = np.random.default_rng(5)
    fps, base = rng.integers(0, 256, (40, 5), np.uint8), rng.integers(0, 256, 5, np.uint8)
    pivots = np.array([[b ^ (255 * f) for b, f in zip(base.tolist(), flips)] for flips in itertools.product((0, 1), repeat=5)], np.uint8)
    table = np.bitwise_count(fps[:, None] ^ pivots[None]).sum(2).astype(int)
    i, j = np.triu_indices(40, 1)
    want = np.abs(table[i] - table[j]).max(1)
    rows = np.bitwise_count(fps ^ base).view(np.int8)
    assert (simhash.greatest_difference(rows, i, j) == want).all()


def test_pivots_discard_far_pairs_and_no_near_one():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 256, (1000, 32), np.uint8)
    fps[500:] = fps[:500] ^ (rng.random((500, 32)) < 0.3) * (1 << rng.integers(0, 8, (500, 32))).astype(np.uint8)
    rows = simhash.unpacked(simhash.pivot_table(fps, simhash.base_pivot()))
    i, j = np.triu_indices(1000, 1)
    found = simhash.greatest_difference(rows, i, j)
    d = simhash.hamming(fps.view(np.uint64)[i], fps.view(np.uint64)[j])
    assert (found <= d).all() and (d <= 32).sum() >= 500
    assert (found > 32)[d > 64].mean() > 0.95


def test_more_bands_for_more_entries():
    plans = [simhash.band_plan(n) for n in (0, 1000, 1 << 20, 1 << 24, 1 << 34)]
    assert [size for _, size in plans] == [20, 20, 20, 24, 34]
    for bands, size in plans:
        share = np.prod([(224 - k) / (256 - k) for k in range(size)])
        assert 1 - (1 - share) ** bands >= 0.9


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 200), (300, 200), (300, 400), (7, 7)]
    got = {r["id"]: r["root"] for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {200: 100, 300: 100, 400: 100}


def test_one_of_each_group_stays(spark):
    t = "one two three four five six seven"
    rows = [(3, t, "c"), (1, t.upper(), "a"), (2, t, "b"), (5, "other words here", "d"), (5, "other words here", "d"), (5, "a third text", "h"), (None, t, "n"), (6, None, "e"), (7, "", "f"), (8, "", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted(r["id"] for r in simhash.drop_near_duplicates(df).collect())
    assert got == ["a", "d", "e", "f", "g", "h"]
    assert simhash.drop_near_duplicates(df).columns == df.columns


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0
