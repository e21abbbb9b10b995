import random

import numpy as np
import pytest

from lexiloom.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def halves(spark):
    docs = spark.read.parquet(DATA)
    model = langid.fit(docs.filter("doc_id % 2 = 0"))
    return model, docs.filter("doc_id % 2 = 1").select("text", "lang").toPandas()


def test_held_out_accuracy(halves):
    model, rest = halves
    share, _ = langid.mixtures(list(rest.text), model)
    top = np.array(model.languages)[share.argmax(1)]
    assert (top == rest.lang).mean() > 0.99
    assert ((share > 0).sum(1) == 1).mean() > 0.93


def test_mixtures(halves):
    model, rest = halves
    rng = random.Random(1)
    by = {x: list(rest.text[rest.lang == x]) for x in ("en", "de", "fr")}
    right, wrong = 0, []
    for _ in range(60):
        a, b = rng.sample(sorted(by), 2)
        wa, wb = rng.choice(by[a]).split()[:150], rng.choice(by[b]).split()[:150]
        share = langid.mixtures([" ".join(wa + wb)], model)[0][0]
        right += {model.languages[j] for j in np.flatnonzero(share)} == {a, b}
        wrong.append(abs(share[model.languages.index(a)] - len(wa) / len(wa + wb)))
    assert right >= 50 and np.mean(wrong) < 0.06


def test_em_rises_to_the_best_share():
    rng = np.random.default_rng(0)
    lik = rng.random((200, 2)) ** 3
    lik /= lik.max(1, keepdims=True)
    share, reached = langid.em(lik, np.array([200]), np.ones((1, 2)))
    grid = max((np.log(lik @ [x, 1 - x]).sum(), x) for x in np.linspace(0.001, 0.999, 999))
    assert abs(share[0, 0] - grid[1]) < 0.02 and reached[0] > grid[0] - 0.01


def test_odd_rows(spark, halves):
    model, _ = halves
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "12 $$ ##", "en", 1), (4, "привет мир как дела сегодня", "ru", 1), (None, "the and of the", "en", 1), (5, "the and of the", None, 1), (5, "the and of the", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    got = langid.identify_languages(df, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by[5]["language"] == "en" and by[5]["accepted"] and by[None]["accepted"]
    for k in (1, 2, 3):
        assert (by[k]["language"], by[k]["languages"], by[k]["n_words"], by[k]["accepted"]) == ("und", [], 0, False)
    assert by[4]["language"] == "und" and not by[4]["accepted"]


def test_keeps_columns_and_handles_empty_tables(spark):
    docs = spark.read.parquet(DATA)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    none = docs.filter("false")
    assert langid.keep_identified(none).count() == 0 and langid.identify_languages(none).count() == 0
    assert langid.fit(none).languages == ("und",)


def test_very_long_text(halves):
    model, rest = halves
    text = " ".join(rest.text[rest.lang == "de"]) * 3
    assert model.languages[langid.mixtures([text], model)[0][0].argmax()] == "de"


def test_texts_beside_a_text_change_nothing(halves):
    model, rest = halves
    rng = random.Random(2)
    texts = [" ".join(rng.choice(list(rest.text)).split()[: rng.randint(1, 120)] + rng.choice(list(rest.text)).split()[: rng.randint(0, 120)]) for _ in range(300)]
    together, n = langid.mixtures(texts, model)
    for t, share, words in zip(texts, together, n):
        alone, m = langid.mixtures([t], model)
        assert (alone[0] == share).all() and m[0] == words


def test_letters_of_all_planes_and_large_alphabets(spark):
    """Two languages of the same 300 letters beyond the basic plane, told apart by which stand together."""
    rng = random.Random(3)
    han = [chr(0x20000 + k) for k in range(300)]

    def text(lang):
        return " ".join("".join(han[(k * 7 + j * (1 if lang == "x" else 2)) % 300] for j in range(4)) for k in (rng.randrange(300) for _ in range(60)))

    rows = [(i, text(lang), lang) for i, lang in enumerate(["x", "y"] * 40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.letters) == 300
    share, n = langid.mixtures([text("x"), text("y"), han[5]], model)
    assert [model.languages[k] for k in share[:2].argmax(1)] == ["x", "y"] and n.tolist() == [60, 60, 1]


def test_a_second_language_that_does_not_pay_hides_no_third():
    """The mixture of all gives the most to a language that explains nothing by itself, less to one that does."""
    names = ("a", "b", "c", "und")
    n = 400
    lik = np.full((n, 4), 1e-9)
    lik[:, 0] = 1.0
    lik[:, 1] = 0.97  # explains the same words a little worse
    lik[:30, 0], lik[:30, 1], lik[:30, 2] = 1e-4, 1e-4, 1.0
    held = langid.word_loglik
    try:
        langid.word_loglik = lambda texts, m: (np.log(lik).astype(np.float32), np.array([n]))
        share, _ = langid.mixtures(["x"], langid.Model(names, *[None] * 8))
    finally:
        langid.word_loglik = held
    assert {names[k] for k in np.flatnonzero(share[0])} == {"a", "c"}
