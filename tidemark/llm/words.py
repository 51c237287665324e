"""Vectorised words of a text: where they are, and a 64-bit hash of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The six ASCII white-space bytes that separate words.
WHITE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 17

_white = np.zeros(256, bool)
_white[list(WHITE_BYTES)] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse, modulo 2 ** 64, for k below n at least."""
    if not _powers or len(_powers[0]) < n:
        m = 1 << max(n, BLOCK).bit_length()
        _powers[:] = [np.concatenate([[np.uint64(1)], np.full(m - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def blocks(raw: bytes) -> Iterator[bytes]:
    """raw cut at white space into blocks of about BLOCK bytes; no word is cut."""
    at = 0
    while len(raw) - at > 2 * BLOCK:
        end = at + BLOCK
        part = np.frombuffer(raw, np.uint8, offset=end)
        white = next((k + int(x[0]) for k in range(0, len(part), BLOCK) if len(x := np.flatnonzero(_white[part[k : k + BLOCK]]))), len(part))
        yield raw[at : end + white]
        at = end + white
    yield raw[at:]


def hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of raw, in order."""
    found = [_hashes(b) for b in blocks(raw)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def _hashes(raw: bytes) -> np.ndarray:
    buf = np.frombuffer(raw, np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64)
    edge = np.flatnonzero(np.diff(_white[buf].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words."""
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += words[k : len(words) - n + 1 + k]
    return mix(out)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles of text, A-Z in lower case, as ascending hashes; of fewer words, the whole sequence as one."""
    if not text:
        return np.empty(0, np.uint64)
    words = hashes(text.encode().lower())  # bytes.lower() takes A-Z only
    if len(words) < n:
        return windows(words, len(words)) if len(words) else words
    return np.unique(windows(words, n))
