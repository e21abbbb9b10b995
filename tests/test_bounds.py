"""What a worker or the driver holds at once doesn't grow with the corpus."""

import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom import queries as core
from lexiloom.operators import encode as E
from lexiloom.operators import evaluate as V
from lexiloom.operators import train as R
from lexiloom.plans import model as M
from lexiloom.tokenizer import Tokenizer


def words(n: int, seed: int = 0) -> list[str]:
    return ["w" + "".join(map(chr, x)) for x in np.random.default_rng(seed).integers(97, 123, (n, 9)).tolist()]


def test_encoding_takes_memory_for_a_chunk_alone():
    model = core.byte_model()
    texts = [" ".join(words(400, k)) for k in range(1000)]  # 4 MB
    tracemalloc.start()
    try:
        ids, counts = model.encode_batch(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert ids.tobytes() == np.frombuffer("".join(texts).encode(), np.uint8).astype(np.int32).tobytes()
    assert counts.tolist() == [len(t) for t in texts]
    assert peak < 160 << 20


def test_chunks_change_no_ids(monkeypatch):
    tok = Tokenizer(core.VOCAB)
    texts = [None, "", "one two", "three<|endoftext|>four", "", " ".join(words(50)), None]
    whole = tok.model.encode_batch(texts)
    monkeypatch.setattr(M, "CHUNK_CHARS", 4)
    parts = tok.model.encode_batch(texts)
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(whole, parts))
    assert [len(x) for x in tok.model.encode_batch([])] == [0, 0]


def test_a_worker_forgets_words_by_their_bytes(monkeypatch):
    monkeypatch.setattr(M, "CACHE_BYTES", 1000)
    model = core.byte_model()
    for k in range(20):
        model.encode_batch([" ".join(words(50, k))])
        assert model.cache.bytes <= 1000 + 600


def test_batches_of_texts_are_short(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(5000).selectExpr("id", "repeat('word ', 2000) text").coalesce(1)
    E.short_batches(spark)

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    assert max(r.n for r in docs.mapInArrow(size, "n long").collect()) < 6 << 20
    assert E.encode_udf(core.byte_model()) and docs.select(E.encode_udf(core.byte_model())("text").alias("ids")).selectExpr("sum(size(ids)) n").first().n == 5000 * 10000


ODD = ["the cat  sat\ton the mat. ", "naïve café — 日本語のテキスト\n\n  indented\tcode = x1 + x2;  ", "aaaaaaa aaaa aaa", "", None, "été   no-break", "x" * 300 + " " + "é" * 200]


def odd_docs(spark, n: int = 40):
    rng = np.random.default_rng(5)
    some = words(30)
    texts = [" ".join(some[i] for i in rng.zipf(1.5, 60) % 30) for _ in range(n)]
    return spark.createDataFrame([(t,) for t in [*texts, *ODD, *ODD]], "text string").repartition(3)


@pytest.mark.parametrize("rule", R.TIES)
def test_merges_over_the_table_with_a_poor_sample(spark, monkeypatch, rule):
    docs = odd_docs(spark)
    want = R.train_bpe(docs, 420, ["<s>"], rule, where="driver").merges
    monkeypatch.setattr(R, "SAMPLE_BYTES", 150)
    monkeypatch.setattr(R, "CHUNK_SYMBOLS", 400)
    assert R.train_bpe(docs, 420, ["<s>"], rule, where="table").merges == want and len(want) > 100


def test_many_symbols_go_by_search(spark, monkeypatch):
    docs = odd_docs(spark)
    specials = [f"<{k}>" for k in range(1000)]
    assert R.train_bpe(docs, 1350, specials, where="table").merges == R.train_bpe(docs, 1350, specials, where="driver").merges


def test_two_stages_over_the_table(spark):
    docs = odd_docs(spark)
    for unit in (128, 7):
        got = [R.train_superbpe(docs, 420, 330, ["<|endoftext|>"], max_unit_len=unit, where=w).merges for w in ("driver", "table")]
        assert got[0] == got[1] and len(got[0]) > 150


def test_the_table_is_written_once(spark, monkeypatch):
    from lexiloom.operators import checkpoint

    n = []
    plain = checkpoint.cut
    monkeypatch.setattr(checkpoint, "cut", lambda df: n.append(1) or plain(df))
    assert len(R.train_bpe(odd_docs(spark), 316, where="table").merges) == 60
    assert len(n) <= 2


def test_examples_read_each_side_once(spark):
    a, b = (spark.range(300).selectExpr(f"concat('w', id % {m}, ' ', id) token", f"(id * 7) % 31 + {m} id") for m in (7, 5))
    plan = V.examples(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 2


def test_examples_of_tokens_that_repeat_or_have_no_id(spark):
    rows = [("a b", 3), ("a b", 1), ("c d", None), (" e", 0), ("e f g", 2), ("é ü", 2), (None, 1)]
    more = [("a b", 9), ("a b", 8), ("x y", 4), ("x y", 4), ("zz", 1), ("  z z", 7)]
    df = lambda x: spark.createDataFrame(x, "token string, id long")
    got = {}
    for r in sorted(V.examples(df(rows), df(more), 3).collect(), key=lambda r: r.k):
        got.setdefault(r.kind, []).append(r.token.encode("latin-1").decode())
    assert got == {
        "shared_earliest": ["a b", "a b"],
        "ours_only_earliest": ["c d", "e f g", "é ü"],
        "theirs_only_earliest": ["x y", "x y", "  z z"],
        "ours_only_longest": ["e f g", "é ü", "c d"],
        "theirs_only_longest": ["  z z", "x y", "x y"],
    }


def test_streams_leave_their_rows_on_disk(spark, tmp_path):
    for mode in ("append", "complete"):
        spark.range(1000).selectExpr("id % 10 id").write.parquet(f"{tmp_path}/{mode}/in")
        df = spark.readStream.schema("id long").parquet(f"{tmp_path}/{mode}/in")
        got = core.finished(df if mode == "append" else df.groupBy("id").count(), mode)
        assert got.count() == (1000 if mode == "append" else 10)
        assert got.inputFiles() and "MemoryPlan" not in got._jdf.queryExecution().analyzed().toString()


def test_a_stream_over_nothing(spark, tmp_path):
    spark.createDataFrame([], "id long").write.parquet(f"{tmp_path}/in")
    df = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    assert core.finished(df, "append").collect() == core.finished(df.groupBy("id").count(), "complete").collect() == []


def test_places_of_pretokens_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "one two two"), (1, "one two two"), (2, None), (None, ""), (3, "zwei " + "x" * 200)], "doc_id long, text string")
    model = core.byte_model()
    got = E.encode_through_dictionary(docs, model)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=lambda r: repr(r)) == sorted(((i, None if t is None else list(t.encode())) for i, t in docs.collect()), key=lambda r: repr(r))


def test_a_dictionary_gives_the_ids(spark, monkeypatch):
    monkeypatch.setattr(E, "DICTIONARY_WORDS", 5)
    docs = odd_docs(spark).selectExpr("hash(text) doc_id", "text")
    model = replace(core.published().model, added=())
    monkeypatch.setattr(M, "CACHE_WORDS", 12)
    show = lambda df: sorted(repr(tuple(r)) for r in df.select("doc_id", "ids").collect())
    assert show(E.encode_through_dictionary(docs, model)) == show(E.encode(docs, model, special=False, keep_text=False))
    known = replace(model, known=(("the", " x"), *model.encode_words(["the", " x"])))
    for _ in range(3):
        assert [x.tolist() for x in known.encode_batch(["the x y the"])] == [x.tolist() for x in model.encode_batch(["the x y the"])]
        known.cache.clear()


def test_the_driver_gets_the_words_of_the_dictionary_alone(spark, monkeypatch):
    monkeypatch.setattr(E, "DICTIONARY_WORDS", 3)
    seen = []
    monkeypatch.setattr(E, "encode", lambda docs, model, *a, **k: seen.append(model.known))
    plans = []
    frame = type(spark.range(1))
    plain = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    docs = spark.createDataFrame([("a a a a a a a a b b b b b c c c d d e e f",)] * 2, "text string").withColumn("doc_id", F.lit(1))
    E.encode_through_dictionary(docs, core.byte_model())
    assert seen[0][0] == (" a", " b", " c")
    assert plans and not any("Limit" in p for p in plans)
