"""Extra columns named as the operators name their own, odd rows and empty tables, through every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import bpe, chroma, html, langid, mixing, quality, queries, secrets, simhash, suffixes, warc

#: Names that the operators use inside, or give their results.
INSIDE = ["id", "h", "s", "e", "n", "k", "u", "t", "a", "b", "x", "key", "keys", "fp", "m", "root", "words", "heads", "gone", "name", "cdf", "rate", "weight", "least", "cuts", "stratum", "symbols", "capitals", "mix_copy", "mix_key", "token_ids", "n_tokens", "language", "languages", "shares", "accepted", "class", "begin", "end", "windows", "entropy", "duplicate_of", "source_doc_ids", "start_word", "good", "rule", "v"]
CLASHES = [*INSIDE, *(f"__{c}" for c in INSIDE), "__source", "__text", "__same_lines", "__long_words"]
PASSAGE = " ".join(f"word{i} and the of" for i in range(30))
ENGLISH = "the house and the garden of the old man were near the river that runs through the town "
KEY = "Zx81hQm2Lk9vR4tYw7Np3Bc6"
TEXTS = [(1, PASSAGE), (2, PASSAGE), (2, PASSAGE), (3, None), (4, ""), (None, ENGLISH + PASSAGE), (None, None), (5, ENGLISH * 20_000), (6, f"my key is {KEY} and the rest of the text is plain"), (7, "?! 12"), (8, ENGLISH)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 3 == 2 else "en", None if k % 4 == 3 else "src0", None if t is None or k % 5 == 4 else len(t), k) for k, (i, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int").repartition(3)
    return df.select("*", *[F.concat(F.lit(c), F.col("row")).alias(c) for c in CLASHES]).drop("row").withColumn("row", F.col("id"))


def mine(df):
    """Rows by the column that tells them apart, and whether the other columns are as they were."""
    rows = df.collect()
    for r in rows:
        k = r["row"][2:]
        assert all(r[c] == c + k for c in CLASHES if c in df.columns)
    return sorted(int(r["row"][2:]) for r in rows), rows


def test_stages_keep_columns(spark, odd):
    names = {n for n, _ in corpus_pipeline.STAGES}
    assert len(names) == 5
    got, _ = mine(corpus_pipeline.identify(spark, odd, ""))
    # a model of these few rows knows the words of most; whether it knows those of row 8 is left open
    assert {0, 1, 2, 5, 7, 10} <= set(got) and not {3, 4, 6, 9} & set(got)
    got, _ = mine(corpus_pipeline.deduplicate(spark, odd, ""))
    assert 0 in got and not {1, 2} & set(got) and {3, 4, 6, 8, 9} <= set(got)
    got, rows = mine(corpus_pipeline.mask(spark, odd, ""))
    assert got == list(range(11))
    masked = next(r for r in rows if r["doc_id"] == 6)
    assert masked["text"] == "my key is [SECRET] and the rest of the text is plain"
    got, rows = mine(corpus_pipeline.mix(spark, odd, ""))
    assert set(rows[0].asDict()) == set(odd.columns) - {"mix_copy", "mix_key"}
    ids = corpus_pipeline.encode(spark, odd, "").collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in ids) == sorted((str(i), str(t)) for i, t in TEXTS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.filter("false"), "").count() == 0


def test_operators(spark, odd):
    assert {r["doc_id"] for r in suffixes.later_copies(odd).collect()} == {2, 5, None}
    _, rows = mine(suffixes.remove_later_copies(odd))
    assert sorted(len(r["text"] or "") for r in rows if r["doc_id"] == 2) == [0, 0]
    assert {(r["doc_id"], r["duplicate_of"]) for r in simhash.near_duplicates(odd).collect()} >= {(2, 1)}
    assert {r["doc_id"] for r in secrets.scan_secrets(odd).collect()} == {6}
    assert langid.identify_languages(odd).count() == 11
    marked = mixing.mix_sources(odd, {"src0": 4.0}, size=3.0, marks=True)
    assert sorted(marked.columns) == sorted(odd.columns)
    assert all(isinstance(r["mix_copy"], int) for r in marked.collect())
    labels = odd.filter("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), "symbols", "v", "lang")
    out = quality.quality_filter(odd, labels)
    assert out.columns == ["doc_id", "lang", *quality.RULES] and out.count() == 11
    assert bpe.bpe_encode(odd, queries.VOCAB).columns == ["doc_id", "token_ids", "n_tokens"]


def clash(df, *more):
    """``df`` with columns of all the names that the operators use inside, but for its own."""
    return df.select("*", *[F.lit(c).alias(c) for c in [*CLASHES, *more] if c not in df.columns])


def test_recordings_pages_and_records(spark):
    sound = [float(x) for x in chroma.melody(chroma.np.random.default_rng(0).normal(0, 0.15, 60))]
    recordings = clash(spark.createDataFrame([(1, sound), (2, sound), (2, sound), (None, sound), (3, None), (4, [])], "rec_id long, samples array<double>"), "notes", "digest", "far", "partner")
    fps = clash(chroma.fingerprints(recordings), "digest", "far", "first", "rec_a", "rec_b")
    assert {(r["rec_a"], r["rec_b"], r["bit_errors"]) for r in chroma.align(fps).collect()} == {(1, 2, 0)}
    assert {(r["rec_id"], r["class_id"], r["links"]) for r in chroma.linked(fps).collect()} == {(1, 1, 0), (2, 1, 0)}
    pages = clash(spark.createDataFrame([(1, "<p>one</p>"), (1, "<p>one</p>"), (None, "plain"), (2, None)], "page_id long, html string"), "text", "n_elements", "n_kept")
    got = html.extract_pages(pages, html.fit([])).collect()
    assert sorted((str(r["page_id"]), str(r["text"]), r["n_elements"]) for r in got) == [("1", "", 1), ("1", "", 1), ("2", "None", 0), ("None", "plain", 0)]
    rows = [(1, "http://a.b/c", 1, "response", 200, {"ETag": "x"}, "body"), (2, "https://a.b/c/", 2, "revisit", 304, {"etag": "x"}, None)]
    records = clash(spark.createDataFrame(rows, "record_id long, url string, fetched long, kind string, status int, headers map<string,string>, payload string"), "stored", "asks", "i", "z", "outcome", "canonical_url", "response_id", "revisit_id")
    assert [(r["revisit_id"], r["response_id"], r["outcome"], r["payload"]) for r in warc.resolve_revisits(records).collect()] == [(2, 1, "resolved", "body")]


def test_a_metric_as_the_stratum_is_refused(spark):
    df = spark.createDataFrame([(1, "text", "x")], "doc_id long, text string, symbols string")
    with pytest.raises(ValueError, match="metric"):
        quality.quality_filter(df, df.selectExpr("doc_id", "1 as quality"), stratum_col="symbols")
