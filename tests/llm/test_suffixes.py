import numpy as np
import pytest

from lexiloom.llm import suffixes


def brute(texts, k):
    """Covered words of each text, by all windows in order."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = texts[i].split()
        cover = set()
        for s in range(len(w) - k + 1):
            win = tuple(w[s : s + k])
            if win in seen:
                cover.update(range(s, s + k))
            seen.add(win)
        if cover:
            out[i] = cover
    return out


def covered(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    return got


def corpus(seed):
    rng = np.random.default_rng(seed)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, 30)) for _ in range(6)]
    texts = {}
    for i in range(40):
        parts = []
        for _ in range(rng.integers(0, 5)):
            if rng.random() < 0.5:
                parts.append(base[rng.integers(len(base))])
            parts.append(" ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(0, 30))))
        texts[i] = " \n".join(parts)
    texts[40] = "same " * 70
    texts[41] = "same " * 30 + "x " * 3 + "same " * 12
    texts[42] = texts[3]
    texts[43] = "a b c d e f g h i j " * 5
    return texts


@pytest.mark.parametrize("seed,k", [(0, 12), (1, 8), (2, 20)])
def test_equals_brute_force(spark, seed, k):
    texts = corpus(seed)
    rows = [*texts.items(), (50, None), (51, "")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, h int").repartition(5)
    got = suffixes.later_copies(df, min_words=k)
    assert covered(got) == brute(texts, k)
    spans = got.collect()
    assert all(r["source_doc_ids"] and max(r["source_doc_ids"]) <= r["doc_id"] for r in spans)


def test_first_stays_and_columns_stay(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one two {passage} three", "a"), (2, f"four {passage}\nfive", "b"), (3, "clean text", "c"), (3, "clean text", "c"), (None, passage, "d"), (4, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted((r["id"], r["text"]) for r in suffixes.remove_later_copies(df).collect())
    assert got == [("a", rows[0][1]), ("b", "four\nfive"), ("c", "clean text"), ("c", "clean text"), ("d", ""), ("e", None)]


def test_repeated_and_null_ids_are_rows_like_others(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage, "a"), (1, passage, "b"), (1, "one " + passage, "c"), (None, passage, "d"), (None, "two " + passage, "e"), (0, "zero " + passage, "f"), (None, passage, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    kept = {r["id"]: r["text"] for r in suffixes.remove_later_copies(df).collect()}
    assert kept["f"] == "zero " + passage
    assert [kept[k] for k in "abdg"] == ["", "", "", ""] and (kept["c"], kept["e"]) == ("one", "two")
    alone = {r["id"]: r["text"] for r in suffixes.remove_later_copies(df.filter("doc_id = 1")).collect()}
    assert alone["b"] == "" and sum(passage in t for t in alone.values()) == 1 and {len(t.split()) for t in alone.values()} <= {0, 1, 60, 61}
    spans = sorted((r["start_word"], r["end_word"], r["source_doc_ids"]) for r in suffixes.later_copies(df.filter("text like 'p%' and doc_id = 1")).collect())
    assert spans == [(0, 60, [1])]
    nameless = suffixes.later_copies(df.filter("doc_id is null")).collect()
    assert len(nameless) == 2 and all(r["doc_id"] is None and r["source_doc_ids"] == [] for r in nameless)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.later_copies(df).count() == 0
    assert suffixes.remove_later_copies(df).count() == 0


def test_longest_previous_factor():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(2, 80))
        t = rng.integers(0, 3, n).astype(np.uint32)
        length, source = suffixes.longest_previous(t, np.full(n, n), np.arange(n), 2)
        for p in range(n):
            best = 0
            for q in range(p):
                k = 0
                while p + k < n and t[p + k] == t[q + k]:
                    k += 1
                best = max(best, k)
            best = best if best >= 2 else 0
            assert length[p] == best
            if best:
                assert source[p] < p and (t[source[p] : source[p] + 2] == t[p : p + 2]).all()
