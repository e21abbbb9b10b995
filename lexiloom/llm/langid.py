"""Language ID by multilingual mixture inference.

A language is a character-trigram model. A document's words are drawn each from
one language; expectation-maximisation estimates the languages' proportions from
the words' trigram likelihoods. The set of languages is chosen by penalised
likelihood: from the best single language on, the one that raises the likelihood
of the mixture most is added as long as it pays its price.
``und``, a uniform model over letters, takes words that no language explains.

A word is a run of letters, ``str.isalpha``, in training as in inference. Trigrams
that a language's sample lacks take a share of their bigrams' probability, and
these of their letters'. Every letter of the samples is told apart; all others
are one more letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, if_small, narrow, offsets, short_batches

TRAIN_DOCS = 500
CHUNK_BYTES = 512 << 10  # some fifty times as much in arrays
PENALTY = 3.0
TOLERANCE, ROUNDS = 1e-3, 60
UNKNOWN = "und"


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    """Of each code point."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in lower case, a line feed after each, and where each begins."""
    low = [(t or "").lower() for t in texts]
    raw = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return raw, offsets(np.array([len(t) + 1 for t in low], np.int64))


def trigrams(codes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of letters' codes (0: none), below ``base``: each word's trigrams and its end, as numbers; where each stands; whether it begins a word."""
    prev = np.concatenate([codes[:0], [0], codes[:-1]]).astype(codes.dtype)
    before = np.where(prev == 0, 0, np.concatenate([[0, 0], codes[:-2]])[: len(codes)]).astype(codes.dtype)
    used = np.flatnonzero((codes > 0) | (prev > 0))
    return (before[used].astype(np.int64) * base + prev[used]) * base + codes[used], used, prev[used] == 0


@dataclass(frozen=True)
class Model:
    """letters: code points, rising; logp: languages by known trigrams, grams their numbers, rising. The rest is for trigrams
    that a language doesn't know: the logarithm of the share that it leaves after two letters (by pair), and of
    the third letter's probability after the second (by known pairs, and by letters for others)."""

    languages: tuple[str, ...]  # the last is und
    letters: np.ndarray
    grams: np.ndarray
    logp: np.ndarray
    pairs: np.ndarray
    left: np.ndarray
    logp2: np.ndarray
    left2: np.ndarray
    logp1: np.ndarray

    @property
    def base(self) -> int:
        return len(self.letters) + 2

    @cached_property
    def codes(self) -> np.ndarray:
        lut = np.where(is_letter(), self.base - 1, 0).astype(np.int32)
        lut[self.letters] = np.arange(1, len(self.letters) + 1)
        return lut

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def log_likelihoods(self, grams: np.ndarray) -> np.ndarray:
        """Languages by the given trigrams."""
        out = np.full((len(self.languages), len(grams)), np.log(1 / self.base), np.float32)
        if len(self.languages) == 1 or not len(grams):
            return out
        low, last = grams % (self.base**2), grams % self.base
        known, at = lookup(self.pairs, low)
        second = np.where(known, self.logp2[:, at], self.left2[:, low // self.base] + self.logp1[:, last])
        known, at = lookup(self.pairs, grams // self.base)
        out[:-1] = np.where(known, self.left[:, at], 0) + second
        known, at = lookup(self.grams, grams)
        out[:-1] = np.where(known, self.logp[:, at], out[:-1])
        return out


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and where."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return (table[at] == keys if len(table) else np.zeros(len(keys), bool)), at


def trigram_counts(docs: DataFrame, train_docs: int, id_col: str, text_col: str, lang_col: str) -> list:
    """(lang, a, b, c, n) over at most ``train_docs`` labelled ids of each language: code points, 0 for the edges of words."""
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang")).filter("id is not null and lang is not null").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = known.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= train_docs).select("id", "lang")
    texts = narrow(docs, id_col, text_col).join(if_small(chosen), "id").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in chunks(iter([b]), CHUNK_BYTES):
                langs = t.column("lang").to_numpy()
                raw, _ = code_points(t.column("text").to_pylist())
                grams, used, _ = trigrams(np.where(is_letter()[raw], raw, 0).astype(np.int64), 1 << 21)
                owner = np.searchsorted(np.flatnonzero(raw == 10), used)  # line feeds within texts part words as well
                text_of = np.repeat(np.arange(len(langs)), [1 + (x or "").count("\n") for x in t.column("text").to_pylist()])
                for lang in sorted(set(langs)):
                    key, n = np.unique(grams[langs[text_of[np.minimum(owner, len(text_of) - 1)]] == lang], return_counts=True)
                    cols = [key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF, n]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["lang", "a", "b", "c", "n"])

    return texts.mapInArrow(run, "lang string, a long, b long, c long, n long").groupBy("lang", "a", "b", "c").agg(F.sum("n").alias("n")).collect()


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram models of the languages that label rows of ``docs``.

    A model is fitted on ``train_docs`` ids of its language at most, chosen by a hash of the id. Rows without an id
    or a label aren't used. Without any labelled row, und is the only model. This runs a job at once.
    """
    rows = [r for r in trigram_counts(docs, train_docs, id_col, text_col, lang_col) if r["lang"] != UNKNOWN]
    languages = sorted({r["lang"] for r in rows})
    number = {x: k for k, x in enumerate(languages)}
    table = np.array([(number[r["lang"]], r["a"], r["b"], r["c"], r["n"]) for r in rows], np.int64).reshape(-1, 5)
    letters = np.unique(table[:, 1:4][table[:, 1:4] > 0])
    base, n_lang = len(letters) + 2, len(languages)
    code = np.zeros(0x110000, np.int64)
    code[letters] = np.arange(1, len(letters) + 1)
    lang, (a, b, c), n = table[:, 0], code[table[:, 1:4].T], table[:, 4]

    def counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, at = np.unique(keys, return_inverse=True)
        out = np.zeros((n_lang, len(known)))
        np.add.at(out, (lang, at), n)
        return known, out

    grams, three = counts((a * base + b) * base + c)
    pairs, two = counts(b * base + c)  # two letters where they end a trigram
    first, context = counts(a * base + b)  # and where they begin one
    one = np.zeros((n_lang, base))
    np.add.at(one, (lang, c), n)
    before = np.zeros((n_lang, base))
    np.add.at(before, (lang, b), n)
    p1 = (one + 0.5) / (one + 0.5).sum(1, keepdims=True)
    p2 = (two + 8 * p1[:, pairs % base]) / (before[:, pairs // base] + 8)
    # every pair that begins a trigram, but for the edge before a word, ends one
    every = np.union1d(pairs, first)
    known, at = lookup(first, every)
    ctx = np.where(known, context[:, at], 0.0)
    known, at = lookup(pairs, every)
    logp2 = np.log(np.where(known, p2[:, at] if len(pairs) else 0.0, 8 * p1[:, every % base] / (before[:, every // base] + 8)))
    second = np.exp(logp2)[:, np.searchsorted(every, grams % base**2)]
    p3 = (three + 4 * second) / (ctx[:, np.searchsorted(every, grams // base)] + 4)
    with np.errstate(divide="ignore"):
        return Model((*languages, UNKNOWN), letters, grams, np.log(p3).astype(np.float32), every, np.log(4 / (ctx + 4)).astype(np.float32), logp2.astype(np.float32), np.log(8 / (before + 8)).astype(np.float32), np.log(p1).astype(np.float32))


def word_loglik(texts: list[str | None], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word (by language), and the number of words of each text."""
    raw, begin = code_points(texts)
    grams, used, first = trigrams(m.codes[raw], m.base)
    first = np.flatnonzero(first)
    if not len(first):
        return np.zeros((0, len(m.languages)), np.float32), np.zeros(len(texts), np.int64)
    n_words = np.bincount(np.searchsorted(begin, used[first], "right") - 1, minlength=len(texts))
    at, distinct = pd.factorize(grams)
    return np.stack([np.add.reduceat(p[at], first) for p in m.log_likelihoods(distinct)], axis=1), n_words


def em(lik: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text by language, and the log-likelihood they reach.

    lik: words by languages, each row's maximum 1; n: words of each text, at least 1;
    allowed: texts by languages, those that may have a share. A text's rounds end when its own proportions
    no longer move, so that they don't depend on the texts beside it.
    """
    share = allowed / allowed.sum(1, keepdims=True)
    live = np.arange(len(n))  # texts whose words are in ``part``
    part, size, moves = lik, n, np.ones(len(n), bool)
    for _ in range(ROUNDS):
        starts = offsets(size)[:-1]
        r = part * np.repeat(share[live], size, axis=0)
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        new = np.stack([np.add.reduceat(r[:, k], starts) for k in range(r.shape[1])], axis=1) / size[:, None]
        step = np.abs(new - share[live]).max(1) > TOLERANCE
        share[live[moves]] = new[moves]
        moves &= step
        if not moves.any():
            break
        if moves.sum() < 0.7 * len(moves):
            part, live, size = part[np.repeat(moves, size)], live[moves], size[moves]
            moves = np.ones(len(live), bool)
    mixed = np.log(np.maximum((lik * np.repeat(share, n, axis=0)).sum(1), 1e-300))
    return share, np.add.reduceat(mixed, offsets(n)[:-1])


def mixtures(texts: list[str | None], m: Model, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by language (0 outside the selected set), and the number of words."""
    ll, n = word_loglik(texts, m)
    k = len(m.languages)
    out = np.zeros((len(texts), k))
    some = np.flatnonzero(n > 0)
    if not len(some):
        return out, n
    size = n[some]
    top = ll.max(1, keepdims=True)
    lik = np.exp((ll - top).astype(np.float64))
    single = np.stack([np.add.reduceat(ll[:, j].astype(np.float64) - top[:, 0], offsets(size)[:-1]) for j in range(k)], axis=1)
    price = penalty * np.log(size + 1)
    _, full = em(lik, size, np.ones((len(some), k)))
    best = np.zeros((len(some), k))
    best[np.arange(len(some)), single.argmax(1)] = 1
    chosen = best > 0
    reached = single.max(1)
    # no set can beat the mixture of all; where that gains less than one language costs, nothing is added
    open_ = np.flatnonzero(full - reached > price)
    while len(open_):
        words = np.repeat(np.isin(np.arange(len(some)), open_), size)
        part, few = lik[words], size[open_]
        gain, added, share = np.zeros(len(open_)), np.full(len(open_), -1), np.zeros((len(open_), k))
        for j in range(k):
            allowed = chosen[open_].astype(float)
            allowed[:, j] = 1
            got, value = em(part, few, allowed)
            more = np.where(chosen[open_, j], 0, value - reached[open_])
            better = more > gain
            gain[better], added[better], share[better] = more[better], j, got[better]
        pays = gain > price[open_]
        open_, added = open_[pays], added[pays]
        chosen[open_, added] = True
        best[open_] = share[pays]
        reached[open_] += gain[pays]
        open_ = open_[full[open_] - reached[open_] > price[open_]]
    out[some] = best
    return out, n


def identify_languages(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, penalty: float = PENALTY) -> DataFrame:
    """(id, language, languages, shares, n_words, accepted) of each row.

    language: the most frequent of the selected set; languages and shares: the set by falling share,
    rounded to 4 places, ties by name. accepted: und has at most half of the words. A text that is
    null, empty or without letters has language und, no languages, 0 words, and isn't accepted.
    Ids may be null or repeat, and are cast to LONG; a row's result depends on its text alone. Without a model, one is fitted on the labelled rows of ``docs``.
    """
    model = model or fit(docs, train_docs, id_col, text_col, lang_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is that of the trigrams in the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for t in chunks(batches, CHUNK_BYTES):
            share, n = mixtures(t.column("text").to_pylist(), m, penalty)
            names, parts, tops = [], [], []
            for row in share:
                got = sorted(((-round(float(x), 4), m.languages[j]) for j, x in enumerate(row) if x > 0))
                names.append([x[1] for x in got])
                parts.append([-x[0] for x in got])
                tops.append(got[0][1] if got else UNKNOWN)
            ok = (n > 0) & (share[:, -1] <= 0.5)
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), pa.array(tops, pa.string()), pa.array(names, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64())), pa.array(n, pa.int64()), pa.array(ok)], names=["id", "language", "languages", "shares", "n_words", "accepted"])

    out = narrow(docs, id_col, text_col).mapInArrow(run, "id long, language string, languages array<string>, shares array<double>, n_words long, accepted boolean")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is accepted. No shuffle: each row is decided by itself.

    Rows go whose text is null, empty or without letters, or of which und has more than half of the words. Ids,
    languages and other columns may be null or repeat; labelled rows serve to fit the model alone.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, train_docs, id_col, text_col, lang_col))
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, CHUNK_BYTES):
            share, n = mixtures(t.column(at).to_pylist(), held.value, penalty)
            yield from t.filter(pa.array((n > 0) & (share[:, -1] <= 0.5))).to_batches()

    return docs.mapInArrow(run, docs.schema)
