"""Words of texts as 64-bit hashes, for many texts at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A word's hash is the sum, modulo 2^64 and mixed at the end, of its
bytes' numbers times the numbers of their places in the word. Both are arbitrary 64-bit numbers, so no pattern of
letters cancels out (powers of one base would let doubling patterns do so). With running sums over the bytes of a
whole group of texts it takes a few array operations and no loop over words. The hash of a word does not depend on
where it stands.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text that are hashed at once; a longer text is cut after a word.
GROUP = 1 << 18
BLANK = re.compile(rb"[\x09-\x0d\x20]")
MASK = (1 << 64) - 1


def _scatter(x: np.ndarray) -> np.ndarray:
    """Arbitrary 64-bit numbers of small ones."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers() -> np.ndarray:
    """A 64-bit number for each byte, those of A-Z being those of a-z."""
    byte = np.arange(256)
    return _scatter(np.where((byte >= 65) & (byte <= 90), byte | 0x20, byte))


NUMBERS = _numbers()
IS_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


@lru_cache(2)
def _places(n: int) -> np.ndarray:
    """An odd number for each of the first ``n`` places of a word."""
    return _scatter(np.arange(n) + 1000) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _hash_joined(data: bytes, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts joined by a blank, and the number of words before each text's start."""
    raw = np.frombuffer(data, np.uint8)
    blank = IS_BLANK[raw]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    first = np.zeros(len(raw), np.int64)
    first[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(first)
    longest = int((ends - starts).max(initial=0))
    # A blank after a word counts for no word; its place is of no matter.
    numbers = _places(1 << max(longest, 63).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(NUMBERS[raw] * numbers[np.minimum(place, len(numbers) - 1)], dtype=np.uint64, out=sums[1:])
    return mix(sums[ends] - sums[starts]), np.searchsorted(starts, starts_of_texts)


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > GROUP:
        found = BLANK.search(text, at + GROUP)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: Iterable[bytes]) -> Iterator[np.ndarray]:
    """Each text's word hashes in order."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        lengths = np.array([len(t) + 1 for t in group])
        hashes, cuts = _hash_joined(b"\n".join(group), np.cumsum(lengths) - lengths)
        for a, b in zip(cuts, [*cuts[1:], len(hashes)], strict=True):
            yield hashes[a:b]

    for text in texts:
        if len(text) > GROUP:
            yield from flush() if group else ()
            group, size = [], 0
            yield np.concatenate([_hash_joined(p, np.zeros(1, np.int64))[0] for p in _pieces(text)])
            continue
        group.append(text)
        size += len(text)
        if size > GROUP:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


def sequence_digest(words: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a text's words in order, as signed 64-bit numbers; zeros without words."""
    if not len(words):
        return 0, 0
    digest = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
