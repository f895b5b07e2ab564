"""Hashes of word shingles for many texts at once, without an object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .common import WORD_TABLE, chunks, splitmix

#: Bytes of text that are handled at once, or one longer text.
CHUNK = 1 << 18
_ODD, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_IS_WORD = np.frombuffer(WORD_TABLE, np.uint8) != 0x20


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    base = 0x5851F42D4C957F2D
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@dataclass
class Shingles:
    """Distinct shingles of texts in a row: those of text i stand at first[i] : first[i + 1]."""

    hash: np.ndarray
    times: np.ndarray
    first: np.ndarray


def shingles(texts: list[str | None], width: int = 5) -> Iterator[tuple[int, int, Shingles]]:
    """For ranges [a, b) of the texts their distinct shingles of `width` words with their numbers of times.

    Words are lower-cased as in `words_of`. A text of fewer words, but not none, has all of them as
    one shingle.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    for a, b in chunks((len(r) + 1 for r in raw), CHUNK):
        yield a, b, _chunk(raw[a:b], width)


def hashed_words(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts in a row, and the number of each word's text."""
    joined = np.frombuffer((b" ".join(raw) + b" ").translate(WORD_TABLE), np.uint8)
    mark = np.zeros(len(joined) + 1, np.int8)
    mark[1:] = joined != 0x20
    turns = np.flatnonzero(np.diff(mark))
    start, end = turns[::2], turns[1::2]
    up, down = _powers(1 << max(19, len(joined).bit_length()))
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(up[: len(joined)] * (joined.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    edges = np.cumsum([len(r) + 1 for r in raw])
    return splitmix((sums[end] - sums[start]) * down[start]), np.searchsorted(edges, start, side="right")


def hashed_shingles(word: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of so many of the hashed words, `splitmix` left out."""
    h = np.zeros(len(word) - width + 1, np.uint64)
    for j in range(width):
        h = (h + word[j : len(h) + j]) * np.uint64(_STEP)
    return h


def _chunk(raw: list[bytes], width: int) -> Shingles:
    word, doc = hashed_words(raw)
    count = np.bincount(doc, minlength=len(raw))
    if len(word) >= width:
        h = hashed_shingles(word, width)
        full = doc[: len(h)] == doc[width - 1 :]
        h, own = splitmix(h[full]), doc[: len(full)][full]
    else:
        h, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        at = np.cumsum(count) - count
        extra = np.zeros(len(few), np.uint64)
        for j in range(width - 1):
            more = count[few] > j
            extra[more] = (extra[more] + word[at[few[more]] + j]) * np.uint64(_STEP)
        h, own = np.concatenate([h, splitmix(extra + count[few].astype(np.uint64))]), np.concatenate([own, few])
    # Equal shingles of one text meet under a mixed key; the texts' order is restored afterwards.
    _, at, times = np.unique(splitmix(h + own.astype(np.uint64) * np.uint64(_ODD)), return_index=True, return_counts=True)
    order = np.argsort(own[at], kind="stable")
    at, times = at[order], times[order]
    return Shingles(h[at], times, np.searchsorted(own[at], np.arange(len(raw) + 1)))
