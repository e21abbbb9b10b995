"""Tokenizer models: immutable tables that a broadcast carries to the workers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import chain, islice

import numpy as np

from ..functions.pretokens import safe_ranges, splitter
from ..functions.schemes import Scheme
from .kernels import PairTable, ends_of, merge_words, spread

SPACE = "▁"
#: Words and bytes of words that a worker keeps the ids of; beyond either it begins anew.
CACHE_WORDS, CACHE_BYTES = 150_000, 6 << 20
#: Texts are split and looked up so many characters at a time, as their words take some fifty times as much memory.
CHUNK_CHARS = 1 << 19
WHITE = "".join(chr(c) for c in [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])


@dataclass(frozen=True)
class AddedToken:
    content: str
    id: int
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = False
    special: bool = True


def token_finder(added: Sequence[AddedToken]) -> re.Pattern | None:
    """Leftmost, and of those the longest."""
    contents = sorted({t.content for t in added if t.content}, key=len, reverse=True)
    return re.compile("|".join(map(re.escape, contents))) if contents else None


def cut_at_added(text: str, finder: re.Pattern | None, by_content: dict[str, AddedToken]) -> list[str | int]:
    """Segments, and the ids of added tokens between them; white space that a token absorbs is gone."""
    if finder is None:
        return [text] if text else []
    out: list[str | int] = []
    at = 0
    while at <= len(text):
        m = finder.search(text, at)
        if m is None:
            break
        t = by_content[m.group()]
        before = text[at : m.start()]
        if t.lstrip:
            before = before.rstrip(WHITE)
        if before:
            out.append(before)
        out.append(t.id)
        at = m.end()
        if t.rstrip:
            while at < len(text) and text[at] in WHITE:
                at += 1
    if at < len(text):
        out.append(text[at:])
    return out


def as_text(text: str | bytes) -> str:
    """Bytes that are not UTF-8 survive as lone surrogates."""
    return text if isinstance(text, str) else bytes(text).decode("utf-8", "surrogateescape")


def as_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def text_chunks(texts: Iterable[str | bytes | None]) -> Iterator[list[str | bytes | None]]:
    """The texts in lists of some CHUNK_CHARS characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) if t else 0
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def joined(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of parts, one after the other."""
    got = [(np.zeros(0, np.int32), np.zeros(0, np.int64)), *parts]
    return np.concatenate([ids for ids, _ in got]).astype(np.int32), np.concatenate([counts for _, counts in got])


class Numbering(dict):
    """Numbers keys as they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class WordCache:
    """Ids of the words seen so far, in one growing array; starts over when it holds too many."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        words, self.flat, counts = self.model.known or ((), np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.number = Numbering(zip(words, range(len(words))))
        self.begin = ends_of(counts)
        self.bytes = 0

    def encode(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all lines' words, one after the other, and the number of ids of each line."""
        if len(self.number) > CACHE_WORDS or self.bytes > CACHE_BYTES:
            self.clear()
        sizes = np.array([len(x) for x in lines], np.int64)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(lines)), np.int64, int(sizes.sum()))
        fresh = list(islice(self.number, len(self.begin) - 1, None))
        if fresh:
            ids, counts = self.model.encode_words(fresh)
            self.flat = np.concatenate([self.flat, ids])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
            self.bytes += sum(map(len, fresh))
        each = self.begin[at + 1] - self.begin[at]
        total = ends_of(each)
        per_line = np.diff(total[ends_of(sizes)])
        return self.flat[spread(self.begin[at], each)], per_line


@dataclass(frozen=True)
class Model:
    """tokens: bytes by id (b"" where there is none); pairs: ranked merges."""

    tokens: tuple[bytes, ...]
    pairs: PairTable
    merges: tuple[tuple[bytes, bytes], ...]
    added: tuple[AddedToken, ...] = ()
    #: Words that are encoded already: these, their ids one after the other, and the number of ids of each.
    known: tuple[tuple[str, ...], np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_") and k in self.__dataclass_fields__}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @property
    def vocab_size(self) -> int:
        return max([len(self.tokens), *(t.id + 1 for t in self.added)])

    @cached_property
    def lookup(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.pairs.keys.tolist(), zip(self.pairs.ranks.tolist(), self.pairs.merged.tolist())))

    @cached_property
    def cache(self) -> WordCache:
        return WordCache(self)

    @cached_property
    def by_content(self) -> dict[str, AddedToken]:
        return {t.content: t for t in reversed(self.added)}

    @cached_property
    def flat_tokens(self) -> tuple[np.ndarray, np.ndarray]:
        table = list(self.tokens) + [b""] * (self.vocab_size - len(self.tokens))
        for t in self.added:
            if not table[t.id]:
                table[t.id] = t.content.encode()
        return np.frombuffer(b"".join(table), np.uint8), ends_of(np.array([len(t) for t in table], np.int64))

    def token_bytes(self, i: int) -> bytes:
        raw, at = self.flat_tokens
        return raw[at[i] : at[i + 1]].tobytes()

    @property
    def vocab(self) -> dict[int, bytes]:
        table = {i: self.token_bytes(i) for i in range(self.vocab_size)}
        return {i: b for i, b in table.items() if b}

    def pieces(self, text: str, special: bool = True) -> list[str | int]:
        """Words in the order of the text, and ids of added tokens."""
        raise NotImplementedError

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def encode_batch(self, texts: Iterable[str | bytes | None], special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each. Null texts have none."""
        return joined(self.encode_chunk(chunk, special) for chunk in text_chunks(texts))

    def encode_chunk(self, texts: list[str | bytes | None], special: bool) -> tuple[np.ndarray, np.ndarray]:
        lines, marks = [], []
        sizes, stamps = [], []
        for t in texts:
            words: list[str] = []
            inserted = []
            for p in self.pieces(as_text(t), special) if t else ():
                if isinstance(p, int):
                    inserted.append((len(words), p))
                else:
                    words.append(p)
            lines.append(words)
            marks.append(inserted)
        ids, counts = self.cache.encode(lines)
        if not any(marks):
            return ids, counts
        begin = ends_of(counts)
        out = []
        for k, (words, inserted) in enumerate(zip(lines, marks)):
            part = ids[begin[k] : begin[k + 1]]
            if inserted:
                get = self.cache.number.__getitem__
                each = np.array([self.cache.begin[get(w) + 1] - self.cache.begin[get(w)] for w in words], np.int64)
                stop = ends_of(each)
                part = np.insert(part, [stop[w] for w, _ in inserted], [i for _, i in inserted])
            out.append(part)
        return (np.concatenate(out) if out else ids).astype(np.int32), np.array([len(p) for p in out], np.int64)

    def encode(self, text: str | bytes, special: bool = True) -> np.ndarray:
        return self.encode_batch([text], special)[0]

    def decode(self, ids: Sequence[int]) -> bytes:
        raise NotImplementedError

    def checked(self, ids: Sequence[int]) -> np.ndarray:
        a = np.asarray(ids)
        if a.size and a.dtype.kind not in "iu":
            raise TypeError(f"token ids are integers, not {a.dtype}")
        a = a.astype(np.int64).ravel()
        if a.size and a.min() < 0:
            raise ValueError("a token id is negative")
        return a

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each of the rows that ``ids`` holds one after the other."""
        begin = ends_of(counts)
        return [self.decode(ids[begin[k] : begin[k + 1]]) for k in range(len(counts))]

    def safe_parts(self, target: int) -> Callable[[str], list[str]]:
        """A function that cuts a text into parts of some ``target`` characters or bytes, whose ids joined are the text's."""
        raise ValueError("no cut is known that changes no ids of this model")

    def continued(self) -> Model:
        """The model of what follows such a cut."""
        return self


UNITS = Scheme("units", (r"(?s).(?:(?!(?<=\S) ).)*",))


def superword_rank(merges: Sequence[tuple[bytes, bytes]], pairs: PairTable) -> int | None:
    """The rank of the first merge that joins a space to what isn't white space before it; None if there is none, or ranks don't follow ids."""
    if len(pairs.ranks) and (np.diff(pairs.merged[np.argsort(pairs.ranks)]) <= 0).any():
        return None
    ranks = np.sort(pairs.ranks)
    return next((int(ranks[k]) for k, (a, b) in enumerate(merges) if b[:1] == b" " and a[-1:].strip()), None)


@dataclass(frozen=True)
class ByteModel(Model):
    """Byte-level BPE: words are UTF-8 bytes from the start."""

    scheme: Scheme = field(default_factory=lambda: Scheme("gpt2", ()))
    byte_ids: tuple[int, ...] = ()
    nfc: bool = False
    prefix_space: bool = False
    ignore_merges: bool = False

    @cached_property
    def finder(self):
        return token_finder(self.added)

    @cached_property
    def split(self):
        return splitter(self.scheme)

    @cached_property
    def units(self) -> ByteModel | None:
        """Where a text is one word: the model of the merges before the first that crosses from a character to a space.

        None of these can cross the end of a unit, which lies between anything but white space and a space. They
        all come before the later ones, and no later merge brings up one of them again, so that encoding units
        (which recur, and are cached) and then merging their tokens equals merging the text at once.
        """
        if not self.scheme.whole or self.ignore_merges:
            return None
        rank = superword_rank(self.merges, self.pairs)
        return None if rank is None else replace(self, pairs=self.pairs.below(rank), scheme=UNITS)

    def encode_batch(self, texts: Iterable[str | bytes | None], special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        if self.units is None:
            return super().encode_batch(texts, special)
        return joined(merge_words(*self.units.encode_batch(chunk, special), self.pairs, self.lookup) for chunk in text_chunks(texts))

    @cached_property
    def byte_table(self) -> np.ndarray:
        return np.array(self.byte_ids, np.int64)

    @cached_property
    def whole_ids(self) -> dict[bytes, int]:
        """Words that are one token without any merging."""
        out = {}
        if self.ignore_merges:
            out = {t: i for i, t in reversed(list(enumerate(self.tokens))) if t}
        return out | {t.content.encode(): t.id for t in self.added if 0 < len(t.content.encode()) < 16}

    def pieces(self, text: str, special: bool = True) -> list[str | int]:
        out: list[str | int] = []
        for p in cut_at_added(text, self.finder if special else None, self.by_content):
            if isinstance(p, int):
                out.append(p)
                continue
            if self.nfc and not p.isascii():
                p = unicodedata.normalize("NFC", p)
            if self.prefix_space and not p.startswith(" "):
                p = " " + p
            out += self.split(p)
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [as_bytes(w) for w in words]
        lengths = np.array([len(b) for b in raw], np.int64)
        symbols = self.byte_table[np.frombuffer(b"".join(raw), np.uint8)]
        if len(symbols) and symbols.min() < 0:
            bad = np.frombuffer(b"".join(raw), np.uint8)[symbols < 0][0]
            raise ValueError(f"the vocabulary has no token for byte {bad}")
        fixed = {k: self.whole_ids[b] for k, b in enumerate(raw) if b in self.whole_ids} if self.whole_ids else {}
        if fixed:  # one symbol that no merge touches
            at = ends_of(lengths)
            keep = np.ones(len(symbols), bool)
            for k, i in fixed.items():
                symbols[at[k]] = i
                keep[at[k] + 1 : at[k + 1]] = False
                lengths[k] = 1
            symbols = symbols[keep]
        return merge_words(symbols, lengths, self.pairs, self.lookup)

    def decode(self, ids: Sequence[int]) -> bytes:
        return self.decode_flat(self.checked(ids), np.array([len(ids)]))[0]

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        a = self.checked(ids)
        raw, at = self.flat_tokens
        if a.size and a.max() >= len(at) - 1:
            raise IndexError(f"token id {a.max()} is outside the vocabulary of {len(at) - 1}")
        size = at[a + 1] - at[a]
        flat = raw[spread(at[a], size)].tobytes()
        ends = ends_of(size)[ends_of(counts)].tolist()
        return [flat[x:y] for x, y in zip(ends, ends[1:])]

    def safe_parts(self, target: int) -> Callable[[str], list[str]]:
        if self.scheme.whole or self.prefix_space:
            return super().safe_parts(target)
        added = [(t.content.encode(), t.rstrip) for t in self.added]

        def parts(t: str) -> list[str]:
            raw = t.encode("utf-8", "surrogatepass")
            return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in safe_ranges(raw, target, added)]

        return parts


@dataclass(frozen=True)
class PieceModel(Model):
    """SentencePiece-like BPE: words are characters, with bytes for those that have no token."""

    normalizers: tuple[tuple, ...] = ()
    prepend: str | None = None  # of Metaspace: never, always, first; None: no Metaspace
    word_split: bool = False
    char_ids: dict = field(default_factory=dict)
    fallback: tuple[int, ...] = ()
    goes_on: bool = False  # texts are what follows a cut

    @cached_property
    def raw_finder(self):
        return token_finder([t for t in self.added if not t.normalized])

    @cached_property
    def normal_tokens(self) -> list[AddedToken]:
        return [AddedToken(self.normalize(t.content), t.id, t.lstrip, t.rstrip) for t in self.added if t.normalized]

    @cached_property
    def normal_finder(self):
        return token_finder(self.normal_tokens)

    @cached_property
    def charsmaps(self) -> dict[bytes, object]:
        from .charsmap import Charsmap

        return {op[1]: Charsmap(op[1]) for op in self.normalizers if op[0] == "charsmap"}

    def normalize(self, s: str, goes_on: bool = False) -> str:
        for op, *args in self.normalizers:
            if op == "prepend":
                s = args[0] + s if s and not goes_on else s
            elif op == "replace":
                s = s.replace(*args)
            elif op == "collapse":
                s = re.sub(" {2,}", lambda m: args[0], s)
            elif op == "strip":
                left, right = args
                s = s.lstrip(WHITE) if left and not goes_on else s
                s = s.rstrip(WHITE) if right else s
            elif op == "charsmap":
                s = self.charsmaps[args[0]].normalize(s)
        return s

    def metaspace(self, s: str, first: bool) -> str:
        if self.prepend is None:
            return s
        s = s.replace(" ", SPACE)
        if s and not s.startswith(SPACE) and (self.prepend == "always" or (self.prepend == "first" and first)):
            s = SPACE + s
        return s

    def words_of(self, s: str) -> list[str]:
        """With a splitting Metaspace each mark starts a word; else a chunk is one word."""
        return re.findall(f"{SPACE}?[^{SPACE}]+|{SPACE}", s) if self.word_split else [s] if s else []

    @cached_property
    def safe_cut(self) -> re.Pattern | None:
        """Between a character that isn't a mark and a mark, where no merge can cross."""
        crosses = re.compile(f"[^{SPACE}]{SPACE}")
        if any(crosses.search(t.decode("utf-8", "replace")) for t in self.tokens):
            return None
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def pieces(self, text: str, special: bool = True) -> list[str | int]:
        out: list[str | int] = []
        first = True
        for p in cut_at_added(text, self.raw_finder if special else None, self.by_content):
            if isinstance(p, int):
                out.append(p)
                first = False
                continue
            normal = {t.content: t for t in reversed(self.normal_tokens)}
            for q in cut_at_added(self.normalize(p, first and self.goes_on), self.normal_finder if special else None, normal):
                if isinstance(q, int):
                    out.append(q)
                else:
                    for w in self.words_of(self.metaspace(q, first)):
                        out += self.safe_cut.findall(w) if self.safe_cut else [w]
                first = False
        return out

    def safe_parts(self, target: int) -> Callable[[str], list[str]]:
        """Cuts come before a space between ASCII letters: no normalizer, added token or merge reaches over it."""
        if self.safe_cut is None or any(" " in t.content or t.rstrip or t.lstrip for t in self.added) or any(op[0] == "replace" and len(op[1]) > 1 and " " in op[1] for op in self.normalizers) or any(op[0] == "charsmap" and self.charsmaps[op[1]].joins_spaces() for op in self.normalizers):
            return super().safe_parts(target)
        spaced = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")

        def parts(t: str) -> list[str]:
            out, at = [], 0
            while m := spaced.search(t, at + target):
                out.append(t[at : m.start()])
                at = m.start()
            return [*out, t[at:]]

        return parts

    def continued(self) -> PieceModel:
        """After a cut there is a space already: before the first segment nothing is put, and nothing taken from its left."""
        return replace(self, goes_on=True)

    def encode_as_it_is(self, text: str) -> np.ndarray:
        """Without added tokens, normalizers and Metaspace."""
        return self.encode_words([text])[0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        symbols: list[int] = []
        lengths = []
        for w in words:
            n = len(symbols)
            for c in w:
                i = self.char_ids.get(c)
                if i is not None:
                    symbols.append(i)
                else:
                    symbols += [self.fallback[b] for b in as_bytes(c) if self.fallback[b] >= 0]
            lengths.append(len(symbols) - n)
        return merge_words(np.array(symbols, np.int64), np.array(lengths, np.int64), self.pairs, self.lookup)

    @property
    def prepends(self) -> bool:
        return self.prepend in ("always", "first") or any(op[0] == "prepend" for op in self.normalizers)

    def decode(self, ids: Sequence[int]) -> bytes:
        a = self.checked(ids)
        raw, at = self.flat_tokens
        a = a[a < len(at) - 1]
        text = raw[spread(at[a], at[a + 1] - at[a])].tobytes().decode("utf-8", "replace").replace(SPACE, " ")
        return (text[1:] if self.prepends and text.startswith(" ") else text).encode()
