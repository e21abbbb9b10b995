import json

import pytest

from lexiloom import BytesSource, TextSource, Tokenizer, train_bpe, train_superbpe
from lexiloom.operators import train as R

SENTENCES = ["the quick brown fox jumps over the lazy dog", "the theme of the thesis is there", "don't do that, they'll see 12345 things", "def f(x):\n    return x ** 2  # square", "naïve café 日本語 aaaa aaaaaaa", "http://example.com/a/b?c=d"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SENTENCES * 5)], "doc_id long, text string")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")


def naive(words, size, specials, rule):
    """Recounts all pairs for every merge."""
    return recount([(list(w.encode()), n) for w, n in words.items()], R.start(specials), size, rule)


def recount(state, tokens, size, rule):
    tie = R.TieBreak(rule, tokens)
    merges = []
    while len(tokens) < size:
        count = {}
        for s, n in state:
            for p in zip(s, s[1:]):
                count[p] = count.get(p, 0) + n
        if not count:
            break
        a, b = min(count, key=lambda p: (-count[p], tie.key(*p)))
        merges.append((tokens[a], tokens[b]))
        tokens.append(tokens[a] + tokens[b])
        for k, (s, n) in enumerate(state):
            out, i = [], 0
            while i < len(s):
                if s[i : i + 2] == [a, b]:
                    out.append(len(tokens) - 1)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            state[k] = out, n
    return merges


@pytest.mark.parametrize("rule", R.TIES)
@pytest.mark.parametrize("where", ["driver", "table"])
def test_equals_recounting(docs, rule, where):
    from lexiloom.functions.pretokens import splitter
    from lexiloom.functions.schemes import by_name

    words = {}
    for s in SENTENCES * 5:
        for w in splitter(by_name("gpt2"))(s):
            words[w] = words.get(w, 0) + 1
    size = 310 if where == "driver" else 280
    got = train_bpe(docs.repartition(3), size, ["<a>"], rule, where=where)
    assert got.merges == naive(words, size, ["<a>"], rule)
    assert got.tokens[256] == b"<a>" and len(got.merges) == size - 257


def test_equals_library(real):
    from tokenizers import Regex, Tokenizer as T, decoders, models, pre_tokenizers, trainers

    from lexiloom.functions.schemes import SCHEMES

    t = T(models.BPE())
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(SCHEMES["gpt2"].patterns[0]), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.decoder = decoders.ByteLevel()
    texts = [r["text"] for r in real.collect()]
    t.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=3000, show_progress=False, initial_alphabet=pre_tokenizers.ByteLevel.alphabet()))
    theirs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in json.loads(t.to_str())["model"]["merges"]]
    mine = train_bpe(real, 3000).to_json()["model"]["merges"]
    assert [tuple(m) for m in mine] == theirs


def test_the_end_of_pairs(spark):
    got = train_bpe(spark.createDataFrame([("ab",)], "text string"), 400)
    assert got.merges == [(b"a", b"b")] and len(got.tokens) == 257
    assert train_bpe(spark.createDataFrame([], "text string"), 400).merges == []


def test_arguments(docs):
    with pytest.raises(ValueError, match="tie_breaking"):
        train_bpe(docs, 300, tie_breaking="alphabet")
    with pytest.raises(ValueError, match="transition_point"):
        train_superbpe(docs, 300, 301)
    with pytest.raises(ValueError, match="twice"):
        train_bpe(docs, 300, ["<a>", "<a>"])
    with pytest.raises(ValueError, match="superword"):
        train_bpe(docs, 300, pretokenizer="x")


def test_sources_agree(spark, docs, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("<|s|>".join(SENTENCES))
    want = train_bpe(spark.createDataFrame([(s,) for s in SENTENCES], "text string"), 300).merges
    assert train_bpe(TextSource(path, "<|s|>"), 300, spark=spark).merges == want
    assert train_bpe(str(path), 300, separator="<|s|>", spark=spark).merges == want
    assert train_bpe("<|s|>".join(SENTENCES).encode(), 300, separator=b"<|s|>", spark=spark).merges == want
    assert train_bpe(BytesSource(SENTENCES), 300, spark=spark).merges == want


def test_superwords(docs):
    timings = {}
    got = train_superbpe(docs, 400, 330, ["<e>"], timings=timings)
    base = train_bpe(docs, 330, ["<e>"])
    crossing = [i for i, t in enumerate(got.tokens) if b" " in t.strip()]
    assert got.tokens[:330] == base.tokens and got.merges[: len(base.merges)] == base.merges
    assert crossing and min(crossing) >= 330 and set(timings) == {"stage1", "stage2"}
    assert train_superbpe(docs, 330, 330, ["<e>"]).tokens == base.tokens
    assert train_superbpe(docs, 345, 330, ["<e>"], where="table").merges == train_superbpe(docs, 345, 330, ["<e>"]).merges


def test_superwords_equal_recounting(spark, real):
    """Stage 2 by hand: lines, cut into 128 bytes between characters, start as the first stage encodes them."""
    few = real.orderBy("doc_id").limit(25)
    base = train_bpe(few, 700, ["<e>"])
    got = train_superbpe(few, 1000, 700, ["<e>"])
    units = {}
    for r in few.collect():
        for line in r["text"].encode().split(b"\n"):
            while line:
                n = min(128, len(line))
                while 0 < n < len(line) and line[n] & 0xC0 == 0x80:
                    n -= 1
                units[line[:n]] = units.get(line[:n], 0) + 1
                line = line[n:]
    index = {t: i for i, t in reversed(list(enumerate(base.tokens)))}
    ranks = {(index[a], index[b]): (k, index[a + b]) for k, (a, b) in reversed(list(enumerate(base.merges)))}

    def pieces(word):
        ids = list(word)
        while best := min(((ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks), default=None):
            i = best[1]
            ids[i : i + 2] = [ranks[ids[i], ids[i + 1]][1]]
        return ids

    state = []
    for unit, n in sorted(units.items()):
        ids = []
        for w in base.model().split(unit.decode()):
            ids += pieces(w.encode())
        state.append((ids, n))
    assert got.merges[: len(base.merges)] == base.merges
    assert got.merges[len(base.merges) :] == recount(state, list(base.tokens), 1000, "huggingface")


def test_superwords_encode_as_at_once(docs):
    from lexiloom.plans.kernels import merge_heap

    got = train_superbpe(docs, 420, 330)
    model = got.model()
    assert model.units is not None
    hard = [*SENTENCES, "  the  the quick\t brown", "the 'lazy' dog's  ", "12 345 the the the\n\n the", " " * 9 + "x" * 100, "日本 語 the"]
    for t in hard:
        assert model.encode(t).tolist() == merge_heap(list(t.encode()), model.pairs, model.lookup)
        assert model.decode(model.encode(t)).decode() == t


def test_exported_file_loads_in_the_library(docs, tmp_path):
    from tokenizers import Tokenizer as T

    for got in (train_bpe(docs, 400, ["<|endoftext|>"]), train_bpe(docs, 350, pretokenizer="o200k"), train_superbpe(docs, 420, 330, ["<e>"])):
        got.save(tmp_path / "t.json")
        other, mine = T.from_file(str(tmp_path / "t.json")), Tokenizer(str(tmp_path / "t.json"))
        for s in [*SENTENCES, "a <|endoftext|> b", "<e>  x"]:
            ids = other.encode(s, add_special_tokens=False).ids
            assert mine.encode(s).tolist() == ids == Tokenizer(got).encode(s).tolist()


def test_result_tables(spark, docs):
    got = train_bpe(docs, 270, ["<e>"])
    v, m = got.vocab_df(spark), got.merges_df(spark)
    assert v.count() == 270 and m.orderBy("rank").first()["merged_id"] == 257
    joined = m.join(v, m.merged_id == v.id).selectExpr("concat(left, right) = token as ok").distinct().collect()
    assert [r["ok"] for r in joined] == [True]
