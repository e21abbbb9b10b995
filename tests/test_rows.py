"""Rows with null or repeated ids, odd columns, padding errors, and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom import Tokenizer
from lexiloom.cli import main, parse_size
from lexiloom.operators import encode as E
from lexiloom.operators import evaluate as V
from lexiloom.operators import post as O

PATH = "/opt/tokenizers"


@pytest.fixture(scope="module")
def tok():
    return Tokenizer(f"{PATH}/byte_bpe_50k.json")


@pytest.mark.parametrize("ids", [[3, 1, None, None, 1], [None] * 6, [10**15, -5, 7 * 10**17, 0, 2], [5] * 9])
def test_running_bytes_keep_every_row(spark, ids):
    rows = [(i, "é" * (k + 1), k) for k, i in enumerate(ids)] + [(8, None, 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, end_byte int")
    got = V.running_bytes(df).collect()
    assert len(got) == len(rows)
    in_order = sorted(got, key=lambda r: r["end_byte"])
    total, place = 0, [(r["doc_id"] is None, r["doc_id"] or 0) for r in in_order if r["text"]]
    for r in in_order:
        total += len((r["text"] or "").encode())
        assert r["end_byte"] == total
    assert place == sorted(place)
    assert V.running_bytes(df.filter("false")).count() == 0
    assert {r["part"] for r in V.train_eval_split(df, 2, 10**6).collect()} <= {"train", "eval"}


def test_parts_of_rows_that_share_an_id_stay_apart(spark, tok):
    long = "the quick brown fox " * 200
    rows = [(1, "ab"), (1, "cd"), (1, "ab"), (None, long), (None, "x"), (2, None), (2, ""), (3, long), (3, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(((i, None if t is None else tok.encode(t).tolist()) for i, t in rows), key=str)
    got = E.encode_giant(df, tok.model, target=300).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == want
    from dataclasses import replace

    plain = replace(tok.model, added=())
    got = E.encode_through_dictionary(df, plain).collect()
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == want


def test_pieces_of_giant_texts(spark):
    pieces = Tokenizer.from_sentencepiece(f"{PATH}/piece_bpe_32k.model")
    rows = [(1, "the quick brown fox jumps over the lazy dog " * 100), (2, "  spaced   out  words é 日本 and more " * 60), (3, "x" * 3000), (4, "a<s>b " * 400), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in E.encode_giant(df, pieces.model, target=200).collect()}
    assert got == {i: pieces.encode(t).tolist() for i, t in rows}
    assert len(pieces.model.safe_parts(200)(rows[0][1])) > 10


def test_columns_of_any_name_and_kind(spark, tok):
    df = spark.createDataFrame([(1, "some text", (2, "x"), {"a": 1})], "doc_id long, text string, `odd col` struct<`a b`:int,`c.d`:string>, m map<string,int>")
    out = tok.encode_df(df)
    assert out.columns == ["doc_id", "text", "odd col", "m", "ids"] and out.first()["odd col"]["a b"] == 2
    back = tok.decode_df(out.drop("text"))
    assert back.first()["text"] == "some text" and back.schema["odd col"] == df.schema["odd col"]


def test_decoding_batches(tok):
    rows = [tok.encode(t) for t in ("one", "", "日本", "three words here")]
    flat, counts = np.concatenate(rows), np.array([len(r) for r in rows])
    assert [b.decode() for b in tok.model.decode_flat(flat, counts)] == ["one", "", "日本", "three words here"]
    assert tok.model.decode_flat(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []
    with pytest.raises(IndexError):
        tok.model.decode_flat(np.array([60_000]), np.array([1]))


def test_padding_errors(spark):
    for bad in ({"truncate": True}, {"pad_to_max_length": True}, {"truncate": True, "max_length": 1, "prefix": (1,), "suffix": (2,)}):
        with pytest.raises(ValueError):
            O.PadTruncate(0, **bad)
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, None), (3, [])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="more than max_length 2"):
        O.pad_truncate(df, O.PadTruncate(0, 2, True)).collect()
    got = {r["doc_id"]: (r["input_ids"], r["attention_mask"], r["length"]) for r in O.pad_truncate(df, O.PadTruncate(9, pad_left=True)).collect()}
    assert got == {1: ([1, 2, 3], [1, 1, 1], 3), 2: ([9, 9, 9], [0, 0, 0], 0), 3: ([9, 9, 9], [0, 0, 0], 0)}
    assert not O.is_rectangular(df.filter("ids is not null")) and O.is_rectangular(df.filter("doc_id = 1"))


def test_padding_encodes_once(spark, tok):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    out = tok.pad_df(docs, O.PadTruncate(0))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 0 and out.count() == 2


def test_examples_have_one_order(spark):
    rows = [(0, "b a"), (0, "a a"), (1, "c a")]
    a = spark.createDataFrame(rows, "id long, token string")
    got = [(r["kind"], r["k"], r["token"]) for r in V.examples(a, a.filter("id = 1")).filter(F.col("kind") == "ours_only_earliest").orderBy("k").collect()]
    assert got == [("ours_only_earliest", 1, "a a"), ("ours_only_earliest", 2, "b a")]


def test_sizes():
    import argparse

    assert [parse_size(x) for x in ("100MB", "2.5gb", "1000", "1KiB", "none", "3 t")] == [100_000_000, 2_500_000_000, 1000, 1000, None, 3 * 10**12]
    for bad in ("", "MB", "1x", "-3MB"):
        with pytest.raises(argparse.ArgumentTypeError):
            parse_size(bad)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    path = tmp_path / "a.txt"
    path.write_text("some words<|s|>and it's 2024<|s|>é 日本" * 20)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    assert main(["bench", f"{PATH}/byte_bpe_50k.json", str(path), "--doc-separator", "<|s|>", "--validate", "--compare-to", "hf", "--comparison-limit", "none"]) == 0
    out = capsys.readouterr().out
    assert "documents agree" in out and "lexiloom" in out and "speed against hf" in out
    assert main(["bench", f"{PATH}/byte_bpe_50k.tiktoken", str(path), "--pretokenizer", "gpt2", "--stream-from-disk"]) == 0
    assert main(["bench", f"{PATH}/byte_bpe_50k.tiktoken", str(path), "--pretokenizer", "gpt2", "--validate"]) == 1
    assert main(["bench", f"{PATH}/byte_bpe_50k.json", str(path), "--validate", "--comparison-limit", "0"]) == 1
    with pytest.raises(SystemExit):
        main([])
