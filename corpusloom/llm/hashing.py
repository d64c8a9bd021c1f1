"""64-bit hashes of words and word runs, for a chunk of texts at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_ODD = lambda n: _RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Random numbers for a byte, for the first places in a word, and for a place in a run of words.
BYTE, PLACE, RUN = _ODD(256), _ODD(4096), _ODD(64)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
FOLDED = BYTE.copy()
FOLDED[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def place_numbers(place: np.ndarray) -> np.ndarray:
    """An odd number for each place in a word: from a table, and beyond it by mixing the place, so that none comes back."""
    numbers = PLACE[np.minimum(place, len(PLACE) - 1)]
    far = np.flatnonzero(place >= len(PLACE))
    if len(far):
        numbers[far] = mix(place[far].astype(np.uint64) * RUN[0] + RUN[1]) | np.uint64(1)
    return numbers


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, start and end of the word in the joined texts, where each text's words begin in these arrays).

    Words are runs of bytes other than ASCII white space; with ``fold``, A-Z count as a-z. The texts are joined by a byte of
    white space, so the byte offset of text i is the sum of the lengths before it plus i.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = ~WHITE[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False].view(np.int8)))
    start, end = edge[::2], edge[1::2]
    text_at = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    first = np.searchsorted(start, text_at)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, first
    inside = np.flatnonzero(word)
    place = inside - np.repeat(start, end - start)
    value = (FOLDED if fold else BYTE)[raw[inside]] * place_numbers(place)
    at = np.r_[0, np.cumsum(end - start)[:-1]]
    return mix(np.add.reduceat(value, at) + (end - start).astype(np.uint64)), start, end, first


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbouring words; empty for fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        total = total + words[i : i + n] * RUN[i]
    return mix(total)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's set of k-word shingles as sorted signed hashes; fewer words are one shingle, no words none."""
    words, _, _, first = word_hashes(texts)
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        runs = run_hashes(words[a:b], min(k, b - a)) if b > a else np.zeros(0, np.uint64)
        sets.append(np.unique(runs.view(np.int64)))
    return sets
