"""The tokenizer that users hold: loading, encoding, decoding, and the interfaces of other libraries."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import encode as ops
from .operators.post import PadTruncate, SubstringMatcher, pad_truncate
from .operators.train import Trained
from .plans import loaders
from .plans.kernels import ends_of
from .plans.model import Model, PieceModel
from .sources.readers import BytesSource, Source, as_documents

NAMED = ("bos_token", "eos_token", "unk_token", "sep_token", "pad_token", "cls_token", "mask_token")


class SpecialTokenFound(ValueError):
    """A text holds patterns that it must not; args[0] has their numbers."""


def named_of(tokenizer) -> dict:
    """Named special tokens of an object that has them as attributes."""
    out = {a: str(v) for a in NAMED if (v := getattr(tokenizer, a, None)) is not None}
    more = getattr(tokenizer, "additional_special_tokens", None)
    return out | ({"additional_special_tokens": [str(t) for t in more]} if more else {})


class Tokenizer:
    """From a path (tokenizer.json or a directory with one, .tiktoken, .model), a cached repository's id, a trained
    vocabulary, a model, another Tokenizer, or a library's tokenizer object that can give its tokenizer.json."""

    def __init__(self, source):
        self.config: dict | None = None
        self.named: dict = {}
        self.specials: dict[str, int] | None = None
        if isinstance(source, Tokenizer):
            self.model, self.config, self.named, self.specials = source.model, source.config, source.named, source.specials
        elif isinstance(source, Model):
            self.model = source
        elif isinstance(source, Trained):
            self.config = source.to_json()
            self.model = source.model()
        elif isinstance(source, (str, os.PathLike)):
            self._load_path(os.fspath(source))
        else:
            text = self._json_of(source)
            self.config = json.loads(text)
            self.model = loaders.from_json(self.config)
            self.named = named_of(source)

    @staticmethod
    def _json_of(source) -> str:
        for obj in (getattr(source, "backend_tokenizer", None), getattr(source, "_tokenizer", None), source):
            if obj is not None and callable(getattr(obj, "to_str", None)):
                return obj.to_str()
        raise TypeError(f"a {type(source).__name__} can't be made a tokenizer")

    def _load_path(self, path: str) -> None:
        if loaders.looks_like_repo_id(path):
            find = lambda name: loaders.cached_file(path, name)
        elif os.path.isdir(path):
            find = lambda name: os.path.join(path, name)
        elif path.endswith(".tiktoken"):
            other = Tokenizer.from_tiktoken(path)
            self.model, self.specials = other.model, other.specials
            return
        elif path.endswith(".model"):
            other = Tokenizer.from_sentencepiece(path)
            self.model, self.config = other.model, other.config
            return
        else:
            find = lambda name: path
        settings = {}
        try:
            place = find("tokenizer_config.json")
            if place != path:
                with open(place, encoding="utf-8") as f:
                    settings = json.load(f)
        except FileNotFoundError:
            pass
        line = loaders.rank_line(settings)
        if line:
            special = {t["content"]: int(i) for i, t in (settings.get("added_tokens_decoder") or {}).items()}
            self.model, self.specials = loaders.from_ranks(find(line[0]), line[1], special), special
            return
        with open(find("tokenizer.json"), encoding="utf-8") as f:
            self.config = json.load(f)
        self.model = loaders.from_json(self.config)

    load = classmethod(lambda cls, source: cls(source))

    @classmethod
    def from_json(cls, data: str | bytes | dict) -> Tokenizer:
        config = data if isinstance(data, dict) else json.loads(data)
        out = cls(loaders.from_json(config))
        out.config = config
        return out

    @classmethod
    def from_tiktoken(cls, path: str | os.PathLike, pretokenizer: str | None = None, special_tokens: Mapping[str, int] | None = None) -> Tokenizer:
        out = cls(loaders.from_ranks(path, pretokenizer, special_tokens))
        out.specials = {t.content: t.id for t in out.model.added}
        return out

    @classmethod
    def from_sentencepiece(cls, source: str | os.PathLike | bytes) -> Tokenizer:
        if not isinstance(source, (bytes, bytearray)):
            with open(source, "rb") as f:
                source = f.read()
        return cls.from_json(loaders.sentencepiece_config(bytes(source)))

    backend = property(lambda self: self.model)
    vocab_size = property(lambda self: self.model.vocab_size)
    vocab = property(lambda self: self.model.vocab)
    merges = property(lambda self: list(self.model.merges))

    def __repr__(self) -> str:
        return f"Tokenizer({type(self.model).__name__}, vocab_size={self.vocab_size})"

    def special_ids(self) -> dict[str, int]:
        """Special tokens by content; of a tokenizer.json those marked special."""
        if self.specials is not None:
            return dict(self.specials)
        return {t.content: t.id for t in self.model.added if t.special}

    def vocab_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, bytearray(b)) for i, b in self.vocab.items()], "id int, token binary")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        index = {b: i for i, b in reversed(list(self.vocab.items()))}
        return spark.createDataFrame([(k, bytearray(a), bytearray(b), index.get(a + b)) for k, (a, b) in enumerate(self.model.merges)], "rank int, left binary, right binary, merged_id int")

    def added_df(self, spark: SparkSession) -> DataFrame:
        rows = [(t.id, t.content, t.special, t.lstrip, t.rstrip, t.normalized) for t in self.model.added]
        return spark.createDataFrame(rows, "id int, content string, special boolean, lstrip boolean, rstrip boolean, normalized boolean")

    # single texts and lists, on the driver

    def encode(self, text: str | bytes) -> np.ndarray:
        return self.model.encode(text).astype(np.uint32)

    def encode_no_normalize(self, text: str) -> np.ndarray:
        """As it is, without added tokens and normalizers; models with byte fallback alone."""
        if not isinstance(self.model, PieceModel):
            raise TypeError("only models with byte fallback have normalizers to leave out")
        return self.model.encode_as_it_is(text).astype(np.uint32)

    def _texts(self, inputs) -> list:
        if isinstance(inputs, BytesSource):
            sep = inputs.separator
            texts = [d if isinstance(d, str) else bytes(d) for d in inputs.data]
            if not sep:
                return texts
            return [p for t in texts for p in t.split(sep if isinstance(t, str) else sep.encode()) if p]
        texts = list(inputs)
        if len({isinstance(t, str) for t in texts}) > 1:
            raise TypeError("texts and bytes are mixed")
        return texts

    def encode_batch(self, inputs: Iterable[str | bytes] | BytesSource, *, parallel: bool | None = None) -> list[np.ndarray]:
        """``parallel`` is taken for the sake of the signature: corpora go through ``encode_df``."""
        ids, counts = self.model.encode_batch(self._texts(inputs))
        return np.split(ids.astype(np.uint32), ends_of(counts)[1:-1]) if len(counts) else []

    def encode_batch_list(self, inputs, *, parallel: bool | None = None) -> list[list[int]]:
        return [x.tolist() for x in self.encode_batch(inputs)]

    def encode_batch_wrapped(self, inputs, prefix: Sequence[int] = (), suffix: Sequence[int] = (), max_tokens: int | None = None, truncate_left: bool = False, forbid: SubstringMatcher | None = None) -> list[list[int]]:
        texts = self._texts(inputs)
        if forbid is not None:
            hit = sorted({k for t in texts for k in forbid.present(t)})
            if hit:
                raise SpecialTokenFound(hit)
        rows = self.encode_batch_list(texts)
        if max_tokens is not None:
            rows = [r[max(0, len(r) - max_tokens) :] if truncate_left else r[:max_tokens] for r in rows]
        return [[*prefix, *r, *suffix] for r in rows]

    def encode_batch_padded(self, inputs, pad_id: int, max_length: int | None = None, pad_to_max_length: bool = False, truncate: bool = False, pad_left: bool = False, truncate_left: bool = False, prefix: Sequence[int] | None = None, suffix: Sequence[int] | None = None, *, parallel: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(matrix, lengths)."""
        o = PadTruncate(pad_id, max_length, pad_to_max_length, truncate, pad_left, truncate_left, tuple(prefix or ()), tuple(suffix or ()))
        extra = len(o.prefix) + len(o.suffix)
        rows = self.encode_batch_wrapped(inputs, o.prefix, o.suffix, max_length - extra if truncate else None, truncate_left)
        lengths = np.array([len(r) for r in rows], np.int64)
        longest = int(lengths.max(initial=0))
        if pad_to_max_length and longest > max_length:
            raise ValueError(f"a sequence has {longest} ids, which is more than max_length {max_length}, and truncation is off")
        width = max_length if pad_to_max_length else longest
        out = np.full((len(rows), width), pad_id, np.uint32)
        for k, r in enumerate(rows):
            out[k, width - len(r) if pad_left else 0 :][: len(r)] = r
        return out, lengths

    def decode(self, tokens: Sequence[int]) -> bytes:
        return self.model.decode(tokens)

    # corpora

    def encode_df(self, docs: DataFrame, col: str = "text", out: str = "ids", special: bool = True) -> DataFrame:
        return ops.encode(docs, self.model, col, out, special)

    def encode_files(self, source: Source | str | Sequence, spark: SparkSession | None = None, *, parallel: bool | None = None) -> DataFrame:
        """(doc_id, ids), a row for each document; order by doc_id for the order of the files."""
        spark = spark or SparkSession.active()
        return ops.encode(as_documents(spark, source), self.model, "text", "ids", keep_text=False)

    def decode_df(self, encoded: DataFrame, col: str = "ids", out: str = "text", skip: Sequence[int] = ()) -> DataFrame:
        df = encoded
        if skip:
            df = df.withColumn(col, F.filter(col, lambda i: ~i.isin(*skip)))
        return ops.decode(df, self.model, col, out)

    def pad_df(self, docs: DataFrame, options: PadTruncate, col: str = "text", batch_col: str | None = None) -> DataFrame:
        return pad_truncate(self.encode_df(docs, col), options, "ids", batch_col)

    def udf(self):
        return ops.encode_udf(self.model)

    def register(self, spark: SparkSession, encode: str = "encode_tokens", decode: str = "decode_tokens") -> None:
        """SQL functions of these names."""
        spark.udf.register(encode, ops.encode_udf(self.model))
        spark.udf.register(decode, ops.decode_udf(self.model))

    def as_hf(self):
        from .compat.transformers_api import FastTokenizer

        return FastTokenizer(self)

    def as_tiktoken(self, name: str = "lexiloom"):
        from .compat.tiktoken_api import Encoding

        return Encoding(self, name)
