"""Words of texts as 64-bit numbers, in numpy: positions, hashes, shingles."""

from __future__ import annotations

import numpy as np

_PRIME = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of a text that are looked at together, about.
STEP = 1 << 21
#: What is left of eight bytes when only the first n count.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: different numbers stay different."""
    x = (x ^ (x >> np.uint64(31))) * _PRIME
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_spans(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of the words: runs of bytes that ``is_word`` (256 flags) marks."""
    starts, ends, first = [], [], 0
    while first < len(data):
        part = np.frombuffer(data, np.uint8, min(STEP, len(data) - first), first)
        inside = is_word[part]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        opened, closed = edge[inside[edge]], edge[~inside[edge]]
        # A word may go on across the border of two steps.
        before = first > 0 and is_word[data[first - 1]]
        if inside[0] and not before:
            opened = np.concatenate(([0], opened))
        if before and not inside[0]:
            closed = np.concatenate(([0], closed))
        starts.append(opened + first)
        ends.append(closed + first)
        first += len(part)
    if data and is_word[data[-1]]:
        ends.append(np.array([len(data)]))
    return tuple(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (starts, ends))


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """A hash of each word, from its bytes eight at a time.

    Each eight go through the finaliser with their place before they are added, so that words are
    told apart by more than the sum of their letters. Words of up to eight bytes take one step. No word is
    ever a Python object, and a word of any length takes memory for its eighths only.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    # Eight bytes from any place on, as one number.
    eight = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))
    size = ends - starts
    salt = mixed(np.array([key], np.uint64))[0]
    first = mixed((eight[starts] & _KEPT[np.minimum(size, 8)]) ^ salt)
    long = np.flatnonzero(size > 8)
    if len(long):
        eighths = (size[long] + 7) // 8 - 1
        owner = np.repeat(np.arange(len(long)), eighths)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(eighths) - eighths, eighths) + 1
        at = starts[long][owner] + 8 * nth
        left = np.minimum(ends[long][owner] - at, 8)
        rest = mixed(mixed((eight[at] & _KEPT[left]) ^ salt) + mixed(nth.astype(np.uint64) + salt))
        first[long] += np.add.reduceat(rest, np.cumsum(eighths) - eighths)
    return mixed(first + mixed(size.astype(np.uint64) ^ salt))


def rolled(words: np.ndarray, n: int, key: int = 0) -> np.ndarray:
    """A hash of each n words that follow each other."""
    count = max(len(words) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for k in range(n if count else 0):
        out += mixed(words[k : k + count] + mixed(np.array([64 * n + k + (key << 16)], np.uint64)))
    return mixed(out)
