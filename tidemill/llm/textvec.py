"""Hashing of words and shingles for whole batches of texts with numpy (runs inside Spark tasks).

A text is UTF-8 bytes; words are runs of bytes other than space and 0x09 to 0x0D, and A-Z count as
a-z. All texts of a batch are hashed together: prefix sums of a polynomial over randomly mapped
bytes give every word's hash by one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are hashed at once; a longer single text is hashed alone.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown as far as they are needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(n, base)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


POWERS = Powers()


def chunks(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES characters in all."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= CHUNK_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes [start, end) of a text."""
    POWERS.grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * POWERS.up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * POWERS.down[starts])


def placed_words(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in turn, where each text's words start (one more at the end), and each word's byte in its text."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer((b" ".join(raw) + b" ").translate(LOWER), np.uint8)
    ends_of_text = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    space = IS_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    hashes = run_hashes(data, starts, ends)
    bounds = np.concatenate(([0], np.searchsorted(starts, ends_of_text)))
    return hashes, bounds, starts - np.repeat(np.concatenate(([0], ends_of_text[:-1])), np.diff(bounds)) if len(texts) else starts


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in turn, and where each text's words start (one more at the end)."""
    return placed_words(texts)[:2]


def shingles_of(hashes: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words.

    A text with fewer words (at least one) has its whole sequence as its only shingle.
    """
    n = max(0, len(hashes) - width + 1)
    joined = np.zeros(n, np.uint64)
    for k in range(width):
        joined += hashes[k : k + n] * _PLACE[k]
    joined = mix(joined)
    out = []
    for i in range(len(bounds) - 1):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            whole = np.uint64(b - a) + (hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)
            out.append(mix(np.array([whole], np.uint64) ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list, width: int) -> Iterator[list[np.ndarray]]:
    """Lists of shingle sets for successive ranges of the texts."""
    for a, b in chunks(texts):
        yield shingles_of(*words_of(texts[a:b]), width)
