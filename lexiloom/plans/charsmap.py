"""The compiled character map of SentencePiece models: a double-array trie and the texts that it leads to."""

from __future__ import annotations

import struct


class Charsmap:
    def __init__(self, blob: bytes):
        if len(blob) < 4:
            raise ValueError("a character map has 4 bytes at least")
        (size,) = struct.unpack_from("<I", blob)
        if size % 4 or 4 + size > len(blob):
            raise ValueError("a character map's trie is longer than the map")
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size :]
        self.seen: dict[str, str | None] = {}

    def longest(self, key: bytes, start: int = 0) -> tuple[int, int] | None:
        """The length of the longest prefix of ``key`` from ``start`` on that the trie holds, and its value."""
        units, found = self.units, None
        if not units:
            return None

        def offset(u: int) -> int:
            return (u >> 10) << ((u & (1 << 9)) >> 6)

        at = offset(units[0])
        for k in range(start, len(key)):
            b = key[k]
            at ^= b
            if b == 0 or at >= len(units):
                break
            u = units[at]
            if u & 0x800000FF != b:
                break
            at ^= offset(u)
            if u >> 8 & 1:
                found = k + 1 - start, units[at] & 0x7FFFFFFF
        return found

    def value(self, at: int) -> str:
        return self.texts[at : self.texts.index(b"\0", at)].decode("utf-8")

    def normalize(self, s: str) -> str:
        """The longest match from the left at each place; what has none stays."""
        raw = s.encode("utf-8", "surrogateescape")
        out, at = [], 0
        size = {**{b: 1 for b in range(0x80)}, **{b: 2 for b in range(0xC0, 0xE0)}, **{b: 3 for b in range(0xE0, 0xF0)}, **{b: 4 for b in range(0xF0, 0x100)}}
        while at < len(raw):
            found = self.longest(raw, at)
            if found:
                out.append(self.value(found[1]))
                at += found[0]
            else:
                n = size.get(raw[at], 1)
                out.append(raw[at : at + n].decode("utf-8", "surrogateescape"))
                at += n
        return "".join(out)

    def joins_spaces(self) -> bool:
        """Whether a key begins with a space, or with a letter of ASCII and goes on with a space."""
        return self.longest(b" ") is not None or any(self.longest(bytes([c]) + b" ") is not None for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
