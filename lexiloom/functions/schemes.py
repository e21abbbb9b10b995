"""Pretokenization schemes.

A scheme is a list of regular expressions in a dialect that Java, with ``(?U)``
in front, and the ``regex`` module read alike. One expression: its matches tile
the text. Several: each splits the pieces of the one before, and what lies
between matches stays a piece.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

L, N, M = r"\p{L}", r"\p{N}", r"\p{M}"
NEWLINES = r"\s*[\r\n]+"
SPACES = [r"\s+(?!\S)", r"\s+"]
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]


def either(*parts: str) -> str:
    return "|".join(parts)


def contraction() -> str:
    return "(?i:" + either(*["'" + s for s in SUFFIXES]) + ")"


def not_of(*classes: str) -> str:
    return "[^" + "".join(classes) + "]"


def lead() -> str:
    """A character that may stand before a run of letters."""
    return not_of(r"\r\n", L, N) + "?"


def other(*letters: str, tail: str = r"\r\n") -> str:
    return " ?" + not_of(r"\s", *letters) + f"+[{tail}]*"


def plain_family(digits: str, letters: str, *classes: str, newlines: str = NEWLINES) -> str:
    return either(contraction(), lead() + letters + "+", digits, other(*classes), newlines, *SPACES)


def cased_family(digits: str, contractions: bool, tail: str, han: bool = False) -> str:
    """Runs of letters in which capitals come first."""
    without = r"&&[^\p{IsHan}]" if han else ""
    upper = "[" + "".join(rf"\p{{{c}}}" for c in ("Lu", "Lt", "Lm", "Lo", "M")) + without + "]"
    lower = "[" + "".join(rf"\p{{{c}}}" for c in ("Ll", "Lm", "Lo", "M")) + without + "]"
    end = contraction() + "?" if contractions else ""
    first = [r"[\p{IsHan}]+"] if han else []
    return either(*first, lead() + upper + "*" + lower + "+" + end, lead() + upper + "+" + lower + "*" + end, digits, other(L, N, tail=tail), NEWLINES, *SPACES)


def first_generation() -> str:
    short = "'(?:" + either("[sdmt]", "ll", "ve", "re") + ")"
    return either(short, *[" ?" + c + "+" for c in (L, N, not_of(r"\s", L, N))], *SPACES)


ONE, THREE = N, N + "{1,3}"
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def staged() -> list[str]:
    signs = "[" + "".join("\\" + c if c in r"-[\]" else c for c in SIGNS) + "]"
    ranges = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x4E00, 0x9FA5), (0x3040, 0x309F), (0x30A0, 0x30FF)))
    marks = r"\p{P}\p{S}"
    words = either(signs + "[A-Za-z]+", not_of("\r\n", L, marks) + "?[" + L + M + "]+", " ?[" + marks + "]+[\r\n]*", NEWLINES, *SPACES)
    return [THREE, f"[{ranges}]+", words]


@dataclass(frozen=True)
class Scheme:
    name: str
    patterns: tuple[str, ...]

    @property
    def whole(self) -> bool:
        """A text is one piece."""
        return not self.patterns


SCHEMES = {
    s.name: s
    for s in (
        Scheme("gpt2", (first_generation(),)),
        Scheme("gpt4", (plain_family(THREE, L, L, N, newlines=r"\s*[\r\n]"),)),
        Scheme("qwen2", (plain_family(ONE, L, L, N),)),
        Scheme("qwen35", (plain_family(ONE, f"[{L}{M}]", L, M, N),)),
        Scheme("olmo3", (plain_family(THREE, L, L, N),)),
        Scheme("deepseek_v3", tuple(staged())),
        Scheme("o200k", (cased_family(THREE, True, r"\r\n/"),)),
        Scheme("nemotron", (cased_family(ONE, False, r"\r\n/"),)),
        Scheme("kimi", (cased_family(THREE, True, r"\r\n", han=True),)),
        Scheme("superbpe_stage1", (cased_family(THREE, False, r"\r\n/"),)),
        Scheme("superword", ()),
    )
}
ALIASES = {"r50k": "gpt2", "cl100k": "gpt4"}


def by_name(name: str) -> Scheme:
    """Raises a ValueError that lists the names if there is no such scheme."""
    found = SCHEMES.get(ALIASES.get(name, name))
    if found is None:
        raise ValueError(f"no pretokenization scheme {name!r}; there are {', '.join([*SCHEMES, *ALIASES])}")
    return found


def possessive_gpt4() -> str:
    """The other spelling of gpt4, with possessive repeats."""
    short = "'(?i:" + either("[sdmt]", "ll", "ve", "re") + ")"
    return either(short, lead() + "+" + L + "++", THREE + "+", " ?" + not_of(r"\s", L, N) + r"++[\r\n]*+", r"\s++$", r"\s*[\r\n]", *SPACES)


def by_patterns(patterns: Sequence[str]) -> Scheme | None:
    """The scheme whose Split expressions a tokenizer file holds, if any."""
    given = tuple(patterns)
    if given == (possessive_gpt4(),):
        return SCHEMES["gpt4"]
    return next((s for s in SCHEMES.values() if s.patterns == given and s.name != "kimi"), None)


def java(pattern: str) -> str:
    return "(?U)" + pattern


def python(pattern: str) -> str:
    """For the ``regex`` module, with set operations."""
    return "(?V1)" + pattern.replace(r"\p{IsHan}", r"\p{Han}")


ASCII = {"L": "A-Za-z", "N": "0-9", "M": "", "Lu": "A-Z", "Lt": "", "Lm": "", "Lo": "", "Ll": "a-z"}
BLANKS = "\\t-\\r "


def ascii_only(pattern: str) -> str | None:
    """The same for texts of ASCII alone in the dialect of ``re``, which is the faster engine; None where a class has no such form."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        if m := re.compile(r"\\p\{(\w+)\}").match(pattern, at):
            if m[1] not in ASCII or not (inside or ASCII[m[1]]):
                return None
            out.append(ASCII[m[1]] if inside else f"[{ASCII[m[1]]}]")
            at = m.end()
            continue
        two = pattern[at : at + 2]
        if two in (r"\s", r"\S"):
            if two == r"\S" and inside:
                return None
            out.append(BLANKS if inside else f"[{'^' if two[1] == 'S' else ''}{BLANKS}]")
            at += 2
        elif two[0] == "\\":
            out.append(two)
            at += 2
        elif two == "&&":
            return None
        else:
            inside = (inside or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            at += 1
    return "".join(out)
