"""Hashes of words, word shingles and their sketches, in numpy."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash

#: Words whose hashes a worker keeps; beyond that it starts anew.
KEPT_WORDS = 150_000
#: Characters of texts whose words are hashed at once.
PIECE = 1 << 16
#: Which characters part words; the last one stands for all beyond.
_SPACES = np.array([chr(c).isspace() for c in range(0x3002)])
_SPACE = re.compile(r"\s")
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


@functools.lru_cache(maxsize=1)
def _kept() -> _Hashes:
    return _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, which white space parts, in lower case."""
    kept = _kept()
    if len(kept) > KEPT_WORDS:
        kept.clear()
    words = text.lower().split() if text else []
    return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, cut between words; words of over 2 * PIECE become their digests."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + PIECE)
        piece = text[at : gap.start() if gap else len(text)]
        at += len(piece)
        if len(piece) > 2 * PIECE:
            piece = " ".join(w if len(w) <= 2 * PIECE else xxhash.xxh3_128_hexdigest(w.encode("utf-8", "surrogatepass")) for w in piece.split())
        yield piece


def _hashed(texts: list[str]) -> list[np.ndarray]:
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    space = _SPACES[np.minimum(codes, len(_SPACES) - 1)]
    edges = np.nonzero(np.diff(space, prepend=True))[0]
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    # a word's hash is the sum of those of its characters with their places
    first = np.cumsum(sizes) - sizes
    chars = codes[~space].astype(np.uint64)
    chars += ((np.arange(len(chars)) - np.repeat(first, sizes)) << 21).view(np.uint64) + np.uint64(1)
    words = np.add.reduceat(mixed(chars), first)
    return np.split(words, np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts])[:-1]))


def hashed(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """64-bit hashes of the same words as those of ``word_hashes``, of each text; other hashes, which take a third of the time as no word becomes an object."""
    some, held = [], 0
    for text in texts:
        text = text.lower() if text else ""
        if held + len(text) > PIECE:
            yield from _hashed(some)
            some, held = [], 0
        if len(text) > PIECE:
            yield np.concatenate([_hashed([x])[0] for x in _pieces(text)])
        else:
            some.append(text)
            held += len(text) + 1
    yield from _hashed(some)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of a shorter text, the hash of all its words."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mixed(out + words[i : i + n])
    return out


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    return np.unique(grams(word_hashes(text), k))


@functools.lru_cache(maxsize=4)
def _multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketch(items: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima of a set under as many hash functions, 32 bits each."""
    by = _multipliers(n)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(items), 4096):
        out = np.minimum(out, ((items[None, at : at + 4096] * by[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return out


def batched(f: Callable[[int, str | None], tuple], batch) -> list[tuple]:
    """``f`` of each (doc_id, text) of an Arrow batch."""
    return [f(doc, text.as_py()) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1))]
