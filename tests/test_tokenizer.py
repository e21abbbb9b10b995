import base64
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import lexiloom as X
from lexiloom.operators import encode as E
from lexiloom.plans import loaders

PATH = os.environ.get("TOKENIZERS", "/opt/tokenizers")
TEXTS = ["Hello world", "", " lead  and   trail ", "don't 12345", "日本語 ñ 😀 é", "a<|endoftext|>b <|endoftext|> c", "<|endoftext|><|endoftext|>", "<|endof|>", "x" * 300 + " " + "ab" * 200, "tab\t\r\n\nend", "ﬁ ＡＢ"]


@pytest.fixture(scope="module")
def tok():
    return X.Tokenizer(f"{PATH}/byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer as T

    return T.from_file(f"{PATH}/byte_bpe_50k.json")


def test_ids_equal_the_library(tok, lib):
    for t in TEXTS:
        assert tok.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids
    assert tok.encode_batch_list(TEXTS) == [lib.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_rank_file(tok):
    r = X.Tokenizer.from_tiktoken(f"{PATH}/byte_bpe_50k.tiktoken", "gpt2", {"<|endoftext|>": 50256})
    assert r.encode_batch_list(TEXTS) == tok.encode_batch_list(TEXTS)
    with pytest.raises(ValueError, match="cl100k_base"):
        X.Tokenizer.from_tiktoken(f"{PATH}/byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("scheme", ["gpt2", "gpt4", "o200k", "qwen2"])
def test_other_rank_file_with_schemes(scheme):
    import tiktoken

    from lexiloom.functions.schemes import SCHEMES

    path = f"{PATH}/byte_bpe_multi_50k.tiktoken"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=SCHEMES[scheme].patterns[0], mergeable_ranks=ranks, special_tokens={})
    mine = X.Tokenizer.from_tiktoken(path, scheme)
    for t in TEXTS:
        assert mine.encode(t).tolist() == enc.encode_ordinary(t)


def test_piece_model():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{PATH}/piece_bpe_32k.model")
    mine = X.Tokenizer.from_sentencepiece(f"{PATH}/piece_bpe_32k.model")
    rng = random.Random(1)
    for t in [*TEXTS, *("".join(rng.choice("ab é漢 \n😀.,1") for _ in range(30)) for _ in range(100))]:
        ids = mine.encode(t).tolist()
        assert ids == sp.encode(t)
        assert mine.decode(ids).decode() == sp.decode(ids)
    assert mine.encode("<s>x</s>").tolist()[0] == 1
    assert mine.decode([5, 10**6]) == mine.decode([5])


def piece_config(prepend, split, lstrip, rstrip, normalized):
    vocab = {"<unk>": 0} | {f"<0x{b:02X}>": b + 1 for b in range(256)}
    for t in ("▁", "a", "b", "▁a", "ab", "▁ab", "▁▁"):
        vocab[t] = len(vocab)
    merges = [["▁", "a"], ["a", "b"], ["▁", "ab"], ["▁", "▁"], ["▁a", "b"]]
    added = [{"id": len(vocab), "content": "<x>", "single_word": False, "lstrip": lstrip, "rstrip": rstrip, "normalized": normalized, "special": False}]
    pre = {"type": "Metaspace", "replacement": "▁", "prepend_scheme": prepend, "split": split}
    model = {"type": "BPE", "dropout": None, "unk_token": "<unk>", "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": True, "byte_fallback": True, "ignore_merges": False, "vocab": vocab, "merges": merges}
    return {"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": pre, "post_processor": None, "decoder": None, "model": model}


@pytest.mark.parametrize("prepend", ["never", "always", "first"])
@pytest.mark.parametrize("split", [True, False])
@pytest.mark.parametrize("lstrip,rstrip", [(False, False), (True, False), (False, True), (True, True)])
@pytest.mark.parametrize("normalized", [True, False])
def test_metaspace_matrix(prepend, split, lstrip, rstrip, normalized):
    from tokenizers import Tokenizer as T

    config = piece_config(prepend, split, lstrip, rstrip, normalized)
    other, mine = T.from_str(json.dumps(config)), X.Tokenizer.from_json(config)
    for t in ["ab", " ab", "ab ab", "a  b", "<x>", "ab <x> ab", "<x>ab", "a <x><x> b", "  <x>  ", "▁ab", "c é", "", "ab   ab", "a<x>"]:
        assert mine.encode(t).tolist() == other.encode(t, add_special_tokens=False).ids, (t, config["pre_tokenizer"])


def test_normalizers():
    config = piece_config("always", True, False, False, False)
    config["pre_tokenizer"] = None
    steps = [{"type": "Strip", "strip_left": True, "strip_right": True}, {"type": "Replace", "pattern": {"Regex": " {2,}"}, "content": " "}, {"type": "Prepend", "prepend": "▁"}, {"type": "Replace", "pattern": {"String": " "}, "content": "▁"}]
    config["normalizer"] = {"type": "Sequence", "normalizers": steps}
    from tokenizers import Tokenizer as T

    other, mine = T.from_str(json.dumps(config)), X.Tokenizer.from_json(config)
    for t in ["ab  ab", "  ab ", "a b", "", "<x> ab"]:
        assert mine.encode(t).tolist() == other.encode(t, add_special_tokens=False).ids
    for bad in ({"type": "NFKC"}, {"type": "Replace", "pattern": {"Regex": "x+"}, "content": "y"}):
        with pytest.raises(ValueError, match="not supported"):
            X.from_json(config | {"normalizer": bad})


def test_compiled_character_map():
    from lexiloom.plans.charsmap import Charsmap

    # a trie of "ab" -> "X" built by hand: units of a double array, with labels and offsets
    units = [0] * 512
    units[0] = 256 << 10 >> 10 << 10  # root leads to 256 ^ label
    a = 256 ^ ord("a")
    units[a] = ord("a") | ((a ^ 400) << 10)
    b = 400 ^ ord("b")
    units[b] = ord("b") | (1 << 8) | ((b ^ 300) << 10)
    units[300] = 1 << 31 | 0
    import struct

    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"X\0"
    assert Charsmap(blob).normalize("abcab aé") == "XcX aé"
    with pytest.raises(ValueError):
        Charsmap(b"\xff\xff\0\0")


def byte_config(tok, **more):
    return json.loads(json.dumps(tok.config)) | more


def test_nfc_prefix_space_and_strips(tok):
    from tokenizers import Tokenizer as T

    c = byte_config(tok, normalizer={"type": "NFC"})
    c["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    c["added_tokens"] = [{"id": 50256, "content": "<|endoftext|>", "single_word": False, "lstrip": True, "rstrip": True, "normalized": False, "special": True}, {"id": 50257, "content": "<|endoftext|>x", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}]
    other, mine = T.from_str(json.dumps(c)), X.Tokenizer.from_json(c)
    for t in [*TEXTS, "é à", "a  <|endoftext|>  b", "<|endoftext|>xy"]:
        assert mine.encode(t).tolist() == other.encode(t, add_special_tokens=False).ids, t


def test_what_cannot_be_loaded(tok):
    for change, message in (
        ({"normalizer": {"type": "Lowercase"}}, "Lowercase"),
        ({"pre_tokenizer": {"type": "Whitespace"}}, "Whitespace"),
        ({"pre_tokenizer": {"type": "Split", "pattern": {"Regex": "x"}, "behavior": "Isolated"}}, "no scheme"),
        ({"model": {"type": "WordPiece", "vocab": {}}}, "WordPiece"),
        ({"model": {"type": "Unigram", "vocab": []}}, "Unigram"),
        ({"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}}, "no token for byte"),
    ):
        with pytest.raises(ValueError, match=message):
            X.from_json(byte_config(tok, **change))


def test_ignore_merges_and_ranked_merges():
    table = loaders.bytes_unicode()
    vocab = {table[b]: b for b in range(256)} | {"abc": 256, "bc": 257, "ab": 258}
    model = {"type": "BPE", "vocab": vocab, "merges": ["b c", "a b"], "ignore_merges": False, "byte_fallback": False}
    config = {"model": model, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "use_regex": True}}
    assert X.Tokenizer.from_json(config).encode("abc").tolist() == [97, 257]
    assert X.Tokenizer.from_json(config | {"model": model | {"ignore_merges": True}}).encode("abc abc").tolist() == [256, 32, 97, 257]
    swapped = model | {"merges": ["a b", "b c"]}
    assert X.Tokenizer.from_json(config | {"model": swapped}).encode("abc").tolist() == [258, 99]


def test_malformed_bytes(tok):
    raw = b"a\xff\xfe b\xc3"
    assert tok.decode(tok.encode(raw)) == raw


def test_decode_refuses(tok):
    for bad, error in (([-1], ValueError), ([10**6], IndexError), ([1.5], TypeError)):
        with pytest.raises(error):
            tok.decode(bad)
    for kind in (np.int32, np.int64, np.uint64, np.uint32):
        assert tok.decode(np.array([15496], kind)) == tok.decode([15496])


def test_dataframes(spark, tok):
    rows = [(i, t, "ids") for i, t in enumerate(TEXTS)] + [(90, None, "n"), (None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    out = tok.encode_df(df)
    want = {r[0]: None if r[1] is None else tok.encode(r[1]).tolist() for r in rows}
    assert out.columns == ["doc_id", "text", "ids"] and {r["doc_id"]: r["ids"] for r in out.collect()} == want
    back = tok.decode_df(out.withColumnRenamed("text", "was"))
    assert back.filter("not (was <=> text)").count() == 0
    via = df.select("doc_id", tok.udf()("text").alias("u"))
    assert {r["doc_id"]: r["u"] for r in via.collect()} == want
    tok.register(spark)
    df.createOrReplaceTempView("t_docs")
    assert spark.sql("SELECT count(*) FROM t_docs WHERE NOT decode_tokens(encode_tokens(text)) <=> text").first()[0] == 0
    assert tok.encode_df(df.filter("false")).count() == 0
    binary = tok.encode_df(df.select("doc_id", F.col("text").cast("binary").alias("text")), out="b")
    assert {r["doc_id"]: r["b"] for r in binary.collect()} == want


def test_other_plans_agree(spark, tok):
    plain = X.Tokenizer.from_tiktoken(f"{PATH}/byte_bpe_50k.tiktoken", "gpt2", {})
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, "the quick brown fox " * 3000), (51, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: None if t is None else plain.encode(t).tolist() for i, t in rows}
    assert {r["doc_id"]: r["ids"] for r in E.encode_through_dictionary(df, plain.model).collect()} == want
    giant = {r["doc_id"]: r["ids"] for r in E.encode_giant(df, tok.model, target=1000).collect()}
    assert giant == {i: None if t is None else tok.encode(t).tolist() for i, t in rows}
    total = E.token_totals(df, plain.model).first()
    assert total["tokens"] == sum(len(x or ()) for x in want.values()) and total["bytes"] == sum(len((t or "").encode()) for _, t in rows)
    with pytest.raises(ValueError):
        E.encode_through_dictionary(df, tok.model)


def test_vocabulary_tables(spark, tok):
    assert tok.vocab_size == 50257 and tok.vocab_df(spark).count() == 50257 and tok.merges_df(spark).count() == 50000
    assert tok.added_df(spark).first()["content"] == "<|endoftext|>"
    assert tok.merges[0] == (tok.model.merges[0][0], tok.model.merges[0][1])


def test_sources_of_tokenizers(tok, lib, tmp_path, monkeypatch):
    (tmp_path / "tokenizer.json").write_text(json.dumps(tok.config))
    for source in (tmp_path, tmp_path / "tokenizer.json", lib, tok, tok.model):
        assert X.Tokenizer(source).encode("Hello world").tolist() == tok.encode("Hello world").tolist()
    monkeypatch.setenv("HF_HUB_CACHE", str(tmp_path / "hub"))
    snap = tmp_path / "hub/models--a--b/snapshots/r1"
    snap.mkdir(parents=True)
    (tmp_path / "hub/models--a--b/refs").mkdir()
    (tmp_path / "hub/models--a--b/refs/main").write_text("r1")
    (snap / "tokenizer.json").write_text(json.dumps(tok.config))
    assert X.looks_like_repo_id("a/b") and not X.looks_like_repo_id("a/b/c") and X.Tokenizer("a/b").vocab_size == 50257
    with pytest.raises(FileNotFoundError):
        X.Tokenizer("a/missing")
    monkeypatch.setenv("HF_TOKEN", " t ")
    assert X.hub_token() == "t"
    kimi = tmp_path / "kimi"
    kimi.mkdir()
    (kimi / "tiktoken.model").write_bytes(open(f"{PATH}/byte_bpe_multi_50k.tiktoken", "rb").read())
    config = {"tokenizer_class": "TikTokenTokenizer", "auto_map": {"AutoTokenizer": ["tokenization_kimi.TikTokenTokenizer", None]}, "added_tokens_decoder": {"50256": {"content": "[BOS]"}}}
    (kimi / "tokenizer_config.json").write_text(json.dumps(config))
    k = X.Tokenizer(kimi)
    assert k.model.scheme.name == "kimi" and k.encode("[BOS]漢字").tolist()[0] == 50256
    with pytest.raises(TypeError):
        X.Tokenizer(3)
