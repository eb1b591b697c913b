"""Word and shingle hashes of whole texts, computed on Arrow buffers with numpy.

A word is a maximal run of bytes other than ``[\\x20\\x09-\\x0D]``; A-Z are
lower-cased. A word's hash is a polynomial over random byte values modulo 2^64,
taken as a difference of prefix sums, so a batch costs a few array passes and no
Python call per word. Buffers are cut into slices of about ``SLICE`` bytes at
white space, which bounds the memory whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_POSITION = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.full(n, b, np.uint64)) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near values spread."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _slice_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words of one slice."""
    inside = ~_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(max(len(data), SLICE + 1))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
        value = (sums[ends] - sums[starts]) * down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(_BASE)), starts


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text (bytes as uint8), in order."""
    found, at = [], 0
    while at < len(data):
        end, step = min(at + SLICE, len(data)), SLICE
        while end < len(data):
            cut = np.flatnonzero(_SPACE[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
                break
            step *= 2
            end = min(at + step, len(data))
        found.append(_slice_hashes(data[at:end])[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def batch_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, word hashes)`` of a string column; a null is an empty text.

    Short texts are hashed together, up to ``SLICE`` bytes at a time, with a space
    between; longer ones alone.
    """
    held: list[int] = []
    parts: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        begins = np.cumsum([0] + [len(p) + 1 for p in parts])
        joined = np.full(int(begins[-1]), 0x20, np.uint8)
        for p, b in zip(parts, begins):
            joined[b : b + len(p)] = p
        hashes, starts = _slice_hashes(joined)
        at = np.searchsorted(starts, begins)
        for row, a, b in zip(held, at[:-1], at[1:]):
            yield row, hashes[a:b]

    for row, text in enumerate(text_bytes(column)):
        if len(text) > SLICE // 4:
            yield row, word_hashes(text)
            continue
        if size + len(text) > SLICE and held:
            yield from flush()
            held, parts, size = [], [], 0
        held.append(row)
        parts.append(text)
        size += len(text) + 1
    if held:
        yield from flush()


def text_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each row as uint8; a null is empty. No copy is made."""
    column = column.cast(pa.large_binary())
    _, offsets, values = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    for i in range(len(column)):
        yield data[ends[i] : ends[i + 1]] if valid[i] else data[:0]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words are one shingle, none are none."""
    if not len(words):
        return words
    width = min(size, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            total = mix(total + words[k : k + len(total)] * _POSITION[k % 4] + np.uint64(k))
    return np.unique(total)
