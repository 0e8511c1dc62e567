"""Word shingles of whole texts as sorted 62-bit hashes, computed for a batch at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from folioforge.llm.batches import as_list, pieces

WIDTH = 5
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+`` of the texts, A-Z in lower case, and the words of each text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum(size + 1)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
    start, stop = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    inner = np.flatnonzero(~blank)
    length = stop - start
    place = np.arange(len(inner)) - np.repeat(np.cumsum(length) - length, length)
    powers = _PLACE
    if (longest := int(length.max())) > len(powers):
        powers = mix(np.arange(1, longest + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
        powers[: len(_PLACE)] = _PLACE
    with np.errstate(over="ignore"):
        value = _BYTE[_LOWER[data[inner]]] * powers[place]
        h = np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64) * _STEP
    return mix(h), np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(texts))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes below 2**62 of each text; a text with fewer words than ``width`` is one shingle, one without words none."""
    words, n = word_hashes(texts)
    total = len(words)
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, total - width + 1), np.uint64)
        for k in range(width if len(h) else 0):  # a slice's end would be negative
            h = (h + words[k : total - width + 1 + k]) * _PLACE[k]
    h = mix(h) >> np.uint64(2)
    out, at = [], 0
    for m in n.tolist():
        if m >= width:
            out.append(np.unique(h[at : at + m - width + 1]))
        elif m:
            v = np.uint64(m)
            with np.errstate(over="ignore"):
                for k in range(m):
                    v = (v + words[at + k]) * _PLACE[k + 8]
            out.append(mix(np.array([v], np.uint64)) >> np.uint64(2))
        else:
            out.append(np.empty(0, np.uint64))
        at += m
    return out


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def sets_of(batches: Iterator[pa.RecordBatch], width: int = WIDTH) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the shingle sets of their ``text``."""
    for whole in batches:
        for b in pieces(whole, "text"):
            yield b, shingle_sets(as_list(b.column("text")), width)
