"""The registered queries that SQL can't express, over their whole tables, against brute force."""

from collections import Counter

import numpy as np
import pytest

from lexiloom.llm import chroma, html, langid, queries, simhash

from . import brute_force

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_op2(spark, texts):
    got = {}
    for r in queries.op2_suffix_array_dedup(spark, DIR).collect():
        assert r["source_doc_ids"] == sorted(set(r["source_doc_ids"])) and r["source_doc_ids"][-1] <= r["doc_id"]
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert got and got == brute_force.later_words(texts, 50)


def test_op9(spark, texts):
    pairs, groups = brute_force.near_groups(list(texts), list(texts.values()), simhash.MAX_DISTANCE)
    got = {r["doc_id"]: r["duplicate_of"] for r in queries.op9_simhash_near_dedup(spark, DIR).collect()}
    assert pairs and set(got) <= set(groups)
    assert sum(got.get(a) == b for a, b in groups.items()) >= 0.9 * len(groups)


def test_op10(spark, docs, texts):
    """Against models and mixtures in plain Python. The sample of each language is all of its rows here."""
    named = {r["doc_id"]: r["lang"] for r in docs.collect()}
    models = brute_force.trigram_models([(named[i], t) for i, t in texts.items()])
    rows = queries.op10_language_mixture(spark, DIR).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    same = 0
    for r in rows:
        want = brute_force.mixture(texts[r["doc_id"]], models, langid.PENALTY)
        assert r["n_words"] == sum(map(bool, brute_force.words_of(texts[r["doc_id"]])))
        if set(r["languages"]) == set(want):
            same += 1
            assert all(abs(x - want[m]) < 2e-3 for m, x in zip(r["languages"], r["shares"]))
            assert r["accepted"] == (r["n_words"] > 0 and want.get("und", 0) <= 0.5)
    assert same >= 0.99 * len(rows)
    assert np.mean([r["language"] == named[r["doc_id"]] for r in rows if r["n_words"] > 20]) > 0.95


def test_op7(spark, docs):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    model = html.fit(html.training_pairs(pages, docs))
    want = Counter((r["page_id"], *html.extract(r["html"], model)) for r in pages.collect())
    got = Counter((r["page_id"], r["text"], r["n_elements"], r["n_kept"]) for r in queries.op7_html_extraction(spark, DIR).collect())
    assert got == want


def test_op6(spark):
    notes = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    fps = {i: chroma.fingerprint(chroma.melody(np.concatenate([v, notes.get(i + 1, v[:0])]))) for i, v in notes.items()}
    rows = spark.createDataFrame([(i, f.view(np.int32).tolist()) for i, f in fps.items()], "rec_id long, fp array<int>")
    got = {(r["rec_a"], r["rec_b"]): r for r in chroma.align(rows).collect()}
    for (a, b), r in got.items():
        assert a < b and (r["bit_errors"], r["bits"]) == brute_force.wrong_bits(fps[a], fps[b], r["offset"])
        assert r["bit_errors"] <= chroma.BIT_ERROR * r["bits"]
    few = sorted(fps)[:60]
    near = {}
    for a in few:
        for b in few:
            if a < b:
                share, offset = brute_force.best_alignment(fps[a], fps[b], 100)
                if share <= chroma.BIT_ERROR:
                    near[a, b] = share
    assert len(near) >= 59
    print("recall", sum(p in got for p in near), len(near), sorted(round(s, 3) for p, s in near.items() if p not in got))
    assert sum(p in got for p in near) >= 0.9 * len(near)
    assert all(got[p]["bit_errors"] <= (near[p] + 1e-9) * got[p]["bits"] or got[p]["bits"] < 3200 for p in near if p in got and near[p] < 0.15)
    links = Counter(i for p in got for i in p)
    seen = {r["rec_id"]: r for r in queries.op6_chroma_fingerprints(spark, DIR).collect()}
    assert {i: r["links"] for i, r in seen.items()} == links and all(r["class_id"] == i for i, r in seen.items())
    for i, r in seen.items():
        share, partner = min((x["bit_errors"] / x["bits"], sum(p) - i) for p, x in got.items() if i in p)
        x = got[min(i, partner), max(i, partner)]
        assert (r["partner"], r["bit_errors"], r["bits"], abs(r["offset"])) == (partner, x["bit_errors"], x["bits"], abs(x["offset"]))
