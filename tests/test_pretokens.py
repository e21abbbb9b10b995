import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import pretokens as P
from lexiloom.functions import schemes as S

EDGES = [
    "", " ", "  a", "a  b", "a \n\n b\r\n\r\nc", "don't I'LL we'Ve 'ſ", "x1234567y ٣٤٥٦", "日本語テスト漢字ABC", "é́e naïve Ünïcode", "😀😀 👍🏽!", "\u0085᠎  x",
    "HelloWORLDfooBar", "a/b//c\n/", "  \t tab", "__init__(self):\n    return {}", "ǅungla ǆ Ǆ", "一aあbアc", "!abc #tag $x", "̀́abc", "1,234.5e-6", "end ",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(0)
    alphabet = "aZéß1٣ \n\r\t'.,/_-漢あア́😀sStTlLvV "
    return EDGES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(300)]


@pytest.mark.parametrize("name", list(S.SCHEMES))
def test_columns_tile_and_equal_the_regex_module(spark, texts, name):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    split = P.splitter(S.by_name(name))
    for r in df.select("i", "text", P.pretokenize("text", name).alias("p")).collect():
        assert "".join(r["p"]) == r["text"]
        assert r["p"] == split(r["text"]), repr(r["text"])


def test_deepseek_equals_sequence_of_splits(spark, texts):
    from tokenizers import Regex, pre_tokenizers

    seq = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(p), "isolated") for p in S.SCHEMES["deepseek_v3"].patterns])
    split = P.splitter(S.SCHEMES["deepseek_v3"])
    for t in texts:
        assert split(t) == [x for x, _ in seq.pre_tokenize_str(t)]


@pytest.mark.parametrize("name", ["gpt2", "gpt4", "qwen2", "qwen35", "olmo3", "o200k", "nemotron", "superbpe_stage1"])
def test_equals_split(texts, name):
    from tokenizers import Regex, pre_tokenizers

    one = pre_tokenizers.Split(Regex(S.SCHEMES[name].patterns[0]), "isolated")
    split = P.splitter(S.SCHEMES[name])
    for t in texts:
        assert split(t) == [x for x, _ in one.pre_tokenize_str(t)]


def test_names():
    assert S.by_name("r50k") is S.by_name("gpt2") and S.by_name("cl100k") is S.by_name("gpt4")
    with pytest.raises(ValueError, match="deepseek_v3"):
        S.by_name("nope")
    assert S.by_patterns([S.possessive_gpt4()]).name == "gpt4" and S.by_patterns(["x"]) is None
    assert all(S.by_patterns(s.patterns) is s for s in S.SCHEMES.values() if s.name not in ("kimi", "superword"))


def test_counts_and_rows(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["pretoken"]: r["count"] for r in P.pretoken_counts(df).collect()} == {"a": 1, " b": 1, " a": 1}
    assert [tuple(r) for r in P.pretoken_rows(df).orderBy("pos").collect()] == [(1, 0, "a"), (1, 1, " b"), (1, 2, " a")]


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    for name in S.SCHEMES:
        assert df.select(P.pretokenize("text", name).alias("p")).first()["p"] is None


def test_long_runs(spark):
    for run in ("a" * 300_000, " " * 300_000, "1" * 300_000, "word " * 100_000):
        for name in ("gpt2", "deepseek_v3", "kimi"):
            got = spark.createDataFrame([(run,)], "text string").select(F.array_join(P.pretokenize("text", name), "").alias("t")).first()["t"]
            assert got == run


def test_safe_ranges_change_nothing(texts):
    text = " ".join(t for t in texts if t).encode() + b" the quick brown fox <a b> jumps " * 20
    added = [(b"<a b>", False), (b"fox", True)]
    ranges = P.safe_ranges(text, 50, added)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(text) and len(ranges) > 5
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert not any(text[:e].endswith(b"fox") for _, e in ranges[:-1])
    for name in ("gpt2", "gpt4", "o200k", "deepseek_v3", "kimi"):
        split = P.splitter(S.by_name(name))
        assert [w for a, b in ranges for w in split(text[a:b].decode())] == split(text.decode())
    assert P.safe_ranges(b"", 10) == [(0, 0)]


@pytest.mark.parametrize("n", [128, 5, 1])
def test_units(spark, n):
    texts = ["ab\ncd é日本😀 xyz" * 9, "", "\n\n", "日本語"]

    def units(t):
        for line in t.encode().split(b"\n"):
            at = 0
            while at < len(line):
                end = min(at + n, len(line))
                while at < end < len(line) and line[end] & 0xC0 == 0x80:
                    end -= 1
                end = end if end > at else min(at + n, len(line))
                yield line[at:end]
                at = end

    want = {}
    for t in texts:
        for u in units(t):
            want[u] = want.get(u, 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["unit"].encode("latin-1"): r["count"] for r in P.unit_counts(df, n).collect()} == want


def test_split_documents(spark):
    df = spark.createDataFrame([("<|s|>a<|s|><|s|>b<|s|>",)], "text string")
    assert df.select(P.split_documents("text", "<|s|>").alias("d")).first()["d"] == ["a", "b"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=[chr(c) for c in range(128)], max_size=80), st.sampled_from(sorted(S.SCHEMES)))
def test_both_engines_split_ascii_alike(text, name):
    import regex

    s = S.SCHEMES[name]
    if len(s.patterns) == 1:
        assert P.splitter(s)(text) == regex.compile(S.python(s.patterns[0])).findall(text)


def test_ascii_forms():
    forms = {n: S.ascii_only(s.patterns[0]) for n, s in S.SCHEMES.items() if len(s.patterns) == 1}
    assert all(forms[n] for n in ("gpt2", "gpt4", "qwen2", "qwen35", "olmo3", "o200k", "nemotron", "superbpe_stage1"))
    assert forms["kimi"] is None and S.ascii_only(r"\p{Greek}") is None
