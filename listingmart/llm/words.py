"""Words, word hashes and shingles of a batch of texts, in numpy.

A word is a run of bytes other than space and the control characters 9 to 13; A-Z count as a-z. All words of a batch
are cut and hashed together, so a text costs no Python step per word. Memory follows the bytes of a batch of texts
(about 40 times); `batches` keeps a batch near a given number of bytes, a longer text makes one alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

BATCH_BYTES = 512 << 10

_WORD_CLASS = np.ones(256, np.uint8)
_WORD_CLASS[[32, *range(9, 14)]] = 0
_NO_CUT = np.zeros((2, 2), bool)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x + np.uint64((seed * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Odd multipliers: one for each place of a byte in a word, one for each place of a word in a shingle.
_BYTES = mix(np.arange(64, dtype=np.uint64), 1) | np.uint64(1)
_STEPS = mix(np.arange(64, dtype=np.uint64), 2) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    global _BYTES
    if len(_BYTES) < n:
        _BYTES = mix(np.arange(2 * n, dtype=np.uint64), 1) | np.uint64(1)
    return _BYTES


def batches(texts: Sequence[str | None], size: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, the texts as UTF-8) in groups of about ``size`` bytes."""
    first, group, held = 0, [], 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if group and held + len(raw) > size:
            yield first, group
            first, group, held = i, [], 0
        group.append(raw)
        held += len(raw)
    if group:
        yield first, group


def word_hashes(raws: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each text's words in them (one more than texts)."""
    _, _, _, hashes, offsets = units(raws, _WORD_CLASS, _NO_CUT)
    return hashes, offsets


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` make one shingle of all."""
    n = len(hashes)
    sums = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        sums += hashes[k : k + len(sums)] * _STEPS[k]
    sums = mix(sums, 5)
    found = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= size:
            found.append(np.unique(sums[a : b - size + 1]))
        elif b > a:
            found.append(mix(np.array([(hashes[a:b] * _STEPS[: b - a]).sum()], np.uint64), 5 + b - a))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def units(raws: Sequence[bytes], classes: np.ndarray, cut: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than class 0, cut also where ``cut[class, next class]``: the joined texts, where each unit
    begins and ends in them, its hash, and the offsets of each text's units."""
    joined = b"\n".join([*raws, b""])
    buffer = np.frombuffer(joined, np.uint8)
    kinds = classes[buffer]
    at = np.flatnonzero(kinds)
    if not len(at):
        none = np.zeros(0, np.int64)
        return joined, none, none, none.astype(np.uint64), np.zeros(len(raws) + 1, np.int64)
    kept = kinds[at]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | cut[kept[:-1], kept[1:]])))
    long = np.diff(np.concatenate((first, [len(at)])))
    place = np.arange(len(at)) - np.repeat(first, long)
    value = (_LOWER[buffer[at]].astype(np.uint64) + np.uint64(1)) * _places(int(long.max()))[place]
    hashes = mix(np.add.reduceat(value, first) + long.astype(np.uint64) * _STEPS[0])
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
    begins = at[first]
    return joined, begins, begins + long, hashes, np.concatenate(([0], np.searchsorted(begins, ends)))
