import os

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import bpe

PATH = os.environ.get("TOKENIZERS", "/opt/tokenizers")
JSON, RANKS = f"{PATH}/byte_bpe_50k.json", f"{PATH}/byte_bpe_50k.tiktoken"
TEXTS = ["Hello, world!  it's 2024\r\n\tend  ", "", None, "aaaaaaaaaaaa" * 50, "日本語 ñandú 😀😀 é", "   ", "<|endoftext|>", "x" * 5000 + " y" * 5000, "don't they'll", "\x00\x7f​"]


@pytest.fixture(scope="module")
def merges():
    return bpe.load_merges(JSON)


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def naive(word: bytes, m: bpe.Merges) -> list[int]:
    """The least rank first, one pair at a time."""
    ids = [int(m.byte_ids[b]) for b in word]
    while len(ids) > 1:
        ranks = m.rank_of(np.array(ids[:-1]), np.array(ids[1:]))
        if ranks.max() < 0:
            break
        r = ranks[ranks >= 0].min()
        i = int(np.flatnonzero(ranks == r)[0])
        ids[i : i + 2] = [int(m.merged[r])]
    return ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_equals_other_implementations(merges, other, texts):
    find = regex.compile(bpe.word_pattern()).findall
    ids, counts = merges.encoder.encode(texts)  # keeps the words of the examples before
    parts = np.split(ids, np.cumsum(counts)[:-1]) if texts else []
    for t, p in zip(texts, parts):
        assert p.tolist() == other(t)
        assert p.tolist() == [i for w in find(t) for i in naive(w.encode(), merges)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=[chr(c) for c in range(128)], max_size=60))
def test_both_engines_split_alike(text):
    both = bpe.Splitter()
    assert both.ascii(text) == both.any(text) and "".join(both(text)) == text


def test_a_worker_that_begins_anew_gives_the_same(merges, monkeypatch):
    texts = [f"word{k} of {k % 7} texts, é{k}" for k in range(300)]
    want, n = bpe.Encoder(merges).encode(texts)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    small = bpe.Encoder(merges)
    parts = [small.encode(texts[k : k + 10]) for k in range(0, 300, 10)]
    assert np.array_equal(np.concatenate([p[0] for p in parts]), want) and np.array_equal(np.concatenate([p[1] for p in parts]), n)
    assert len(small.number) < 100


def test_two_files_of_one_vocabulary_agree(merges):
    ranks = bpe.load_merges(RANKS)
    assert np.array_equal(ranks.keys, merges.keys) and np.array_equal(ranks.merged, merges.merged)


def test_query_round_trip(spark, other):
    rows = [(i, t, 7, "z") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, ""), (0, "again", 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, token_ids string").repartition(3)
    out = bpe.bpe_decode(bpe.bpe_encode(df, JSON), JSON)
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "text"]
    got = sorted(((r["doc_id"], r["text"], r["token_ids"], r["n_tokens"]) for r in out.collect()), key=repr)
    want = sorted(((r[0], r[1], None, None) if r[1] is None else (r[0], r[1], other(r[1]), len(other(r[1]))) for r in rows), key=repr)
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_decode(bpe.bpe_encode(df, JSON), JSON).count() == 0


def test_decode_refuses_unknown_ids(spark):
    df = spark.createDataFrame([([1, 60000],)], "token_ids array<int>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.bpe_decode(df, JSON).collect()


def test_merges_out_of_order_are_refused():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    with pytest.raises(ValueError, match="no earlier merge"):
        bpe.Merges.build(tokens, [(256, 99, 257), (97, 98, 256)])
