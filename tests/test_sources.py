"""Sources of documents: kinds, compression, order, errors."""

import gzip
import json
from pathlib import Path

import pytest

from lexiloom.functions.pretokens import pretoken_counts
from lexiloom.plans.charsmap import Charsmap
from lexiloom.sources.readers import BytesSource, JsonlSource, ParquetSource, Source, TextSource, as_documents, detect_format, resolve, spread
from lexiloom.tokenizer import Tokenizer

DOCS = ["one two", "three é 日本", "", "x\ty", "last"]


def texts(spark, source):
    rows = source.documents(spark).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def jsonl(path, docs, field="text", opener=open):
    with opener(path, "wb") as f:
        for d in docs:
            f.write((json.dumps({field: d, "n": 1}) + "\n").encode())
    return str(path)


def test_formats_by_extension():
    assert [detect_format(p) for p in ("a.jsonl", "a.jsonl.gz", "A.JSONL.ZST", "a.parquet", "a.txt", "a", "d.parquet/", "x.jsonl.zstd", "jsonl.txt")] == ["jsonl", "jsonl", "jsonl", "parquet", "text", "text", "parquet", "jsonl", "text"]
    assert isinstance(resolve("a.jsonl"), JsonlSource) and isinstance(resolve(["a.parquet", "b"]), ParquetSource) and isinstance(resolve(Path("a.txt")), TextSource)
    s = TextSource("a")
    assert resolve(s) is s and "TextSource" in repr(s)
    with pytest.raises(ValueError):
        resolve([])
    with pytest.raises(TypeError):
        Source()


def test_jsonl(spark, tmp_path):
    plain = jsonl(tmp_path / "a.jsonl", DOCS)
    assert texts(spark, JsonlSource(plain)) == DOCS
    zipped = jsonl(tmp_path / "b.jsonl.gz", DOCS[::-1], opener=gzip.open)
    assert texts(spark, JsonlSource([zipped, plain])) == DOCS[::-1] + DOCS
    other = jsonl(tmp_path / "c.jsonl", DOCS, field="body")
    assert texts(spark, JsonlSource(other, "body")) == DOCS
    with pytest.raises(Exception, match="no string field"):
        texts(spark, JsonlSource(other))
    (tmp_path / "d.jsonl").write_text('{"text": "good"}\n\n{broken\n{"text": null}\n{"other": 1}\n   \n{"text": "fine"}\n')
    assert texts(spark, JsonlSource(str(tmp_path / "d.jsonl"), on_error="skip")) == ["good", "fine"]
    with pytest.raises(Exception):  # noqa: B017
        texts(spark, JsonlSource(str(tmp_path / "d.jsonl")))
    with pytest.raises(ValueError):
        JsonlSource(plain, on_error="ignore")
    (tmp_path / "e.jsonl").write_text("")
    assert texts(spark, JsonlSource(str(tmp_path / "e.jsonl"))) == []


def test_zstandard(spark, tmp_path):
    import zstandard

    raw = "".join(json.dumps({"text": d}) + "\n" for d in DOCS).encode()
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.compress(raw))
    assert texts(spark, JsonlSource(str(tmp_path / "a.jsonl.zst"))) == DOCS


def test_text(spark, tmp_path):
    for name, body in (("a.txt", "one<|s|>two<|s|><|s|>three\nlines<|s|>"), ("b.txt", ""), ("c.txt", "whole\nfile\n")):
        (tmp_path / name).write_text(body)
    at = lambda n: str(tmp_path / n)
    assert texts(spark, TextSource(at("a.txt"), "<|s|>")) == ["one", "two", "three\nlines"] == texts(spark, TextSource(at("a.txt"), b"<|s|>"))
    assert texts(spark, TextSource([at("c.txt"), at("b.txt"), at("a.txt")])) == ["whole\nfile\n", "", "one<|s|>two<|s|><|s|>three\nlines<|s|>"]
    assert TextSource([at("b.txt"), at("c.txt")]).training_documents(spark).count() == 1
    with pytest.raises(FileNotFoundError):
        texts(spark, TextSource(at("none.txt")))
    with pytest.raises(UnicodeDecodeError):
        TextSource(at("a.txt"), b"\xff")


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    rows = [("a", bytearray(b"raw"), 1), (None, None, 2), ("é", bytearray("ü".encode()), 3)]
    spark.createDataFrame(rows, "text string, raw binary, n int").coalesce(1).write.parquet(path)
    assert texts(spark, ParquetSource(path)) == ["a", "", "é"] and texts(spark, ParquetSource(path, "raw")) == ["raw", "", "ü"]
    with pytest.raises(ValueError, match="available: text, raw, n"):
        texts(spark, ParquetSource(path, "none"))
    with pytest.raises(TypeError):
        texts(spark, ParquetSource(path, "n"))
    assert "ReadSchema: struct<text:string>" in ParquetSource(path).documents(spark)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_bytes(spark):
    assert texts(spark, BytesSource(b"<|s|>a<|s|><|s|>b<|s|>", b"<|s|>")) == ["a", "b"] == texts(spark, BytesSource(["<|s|>a", "b"], "<|s|>"))
    assert texts(spark, BytesSource(["a", "", "c"])) == ["a", "", "c"] and texts(spark, BytesSource("x")) == ["x"]
    raw = [b"ok", b"\xff\xfe broken", b"\xe6\x97"]
    assert [bytes(t) for t in texts(spark, BytesSource(raw))] == raw
    assert BytesSource(raw + [b""]).training_documents(spark).count() == 3
    tok = Tokenizer("/opt/tokenizers/byte_bpe_50k.json")
    ids = {r["doc_id"]: r["ids"] for r in tok.encode_files(BytesSource(raw), spark).collect()}
    assert [tok.decode(ids[k]) for k in range(3)] == raw
    with pytest.raises(TypeError):
        BytesSource([b"a", "b"])
    assert "2 buffers" in repr(BytesSource(["a", "b"]))


def test_counts_over_files(spark, tmp_path):
    paths = [jsonl(tmp_path / f"{k}.jsonl", DOCS) for k in range(3)]
    counts = {r["pretoken"]: r["count"] for r in pretoken_counts(as_documents(spark, paths)).collect()}
    assert counts["one"] == 3 and counts[" two"] == 3 and counts["last"] == 3


def test_a_small_table_is_spread_and_a_large_one_is_not(spark):
    df = spark.range(100).coalesce(1)
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df, 10).rdd.getNumPartitions() == 1


def test_long_keys_of_a_character_map():
    """A trie of one key of 100 letters: only as a whole is it replaced."""
    key = b"k" * 100

    class Chain(Charsmap):
        def __init__(self):
            self.seen = {}

        def longest(self, raw, start=0):
            return (100, 0) if raw.startswith(key, start) else None

        def value(self, at):
            return "v"

    assert Chain().normalize("a" + "k" * 100 + "b") == "avb" and Chain().normalize("k" * 99) == "k" * 99
