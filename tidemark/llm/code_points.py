"""What the tokenizers library takes for letters, numbers and white space, asked of the library itself.

Python's own tables are of another Unicode version. The driver probes every code point once and sends ranges to the
workers; `odd` are the code points for which Python's tables cannot be trusted: unassigned in them, or of another class or
lower case in the library. Texts that hold one are normalised by the library and split by the probed ranges.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

Ranges = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class CodePoints:
    letters: Ranges
    numbers: Ranges
    white: Ranges
    odd: Ranges


def members(ranges: Ranges) -> str:
    """Ranges as the inside of a set of a regular expression."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Holds:
    """Whether a text holds a code point of the ranges (all above Latin-1): a table look-up for each character at most."""

    def __init__(self, ranges: Ranges):
        self.table = np.zeros(0x110000, bool)
        for a, b in ranges:
            self.table[a : b + 1] = True
        if self.table[:256].any():
            raise ValueError("code points of Latin-1 are known")

    def __call__(self, text: str) -> bool:
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            return bool(self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def ranges_of(mask: np.ndarray) -> Ranges:
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return tuple(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


@lru_cache(maxsize=1)
def probe() -> CodePoints:
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    chars = list(map(chr, points.tolist()))
    every = "".join(chars)

    def matched(pattern: str) -> np.ndarray:
        found = np.ones(len(every), bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(every):
            found[a:b] = False
        return found

    def in_python(pattern: str) -> np.ndarray:
        found = np.zeros(len(every), bool)
        for m in regex.finditer(pattern, every):
            found[m.start() : m.end()] = True
        return found

    def whole(mask: np.ndarray) -> Ranges:
        out = np.zeros(0x110000, bool)
        out[points[mask]] = True
        return ranges_of(out)

    letters, numbers, white = matched(r"\p{L}+"), matched(r"\p{N}+"), matched(r"\s+")
    odd = np.array([unicodedata.category(c) == "Cn" for c in chars])
    for of, pattern in ((letters, r"\p{L}+"), (numbers, r"\p{N}+"), (white, r"\p{White_Space}+")):
        odd |= of != in_python(pattern)
    lower = normalizers.Lowercase().normalize_str("\0".join(chars)).split("\0")[1:]  # \0 itself comes first, as two empty parts
    odd |= np.array([False] + [c.lower() != x for c, x in zip(chars[1:], lower[1:], strict=True)])
    return CodePoints(whole(letters), whole(numbers), whole(white), whole(odd))
