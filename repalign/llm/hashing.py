"""Word and shingle hashes of many texts at once, as numpy code over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > 4 * CHUNK_BYTES:  # of one very long text: not kept
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"], _powers["down"]


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``most`` bytes; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        end = min(end, len(texts))
        yield start, end, data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first word of each text and the number of words) after lower-casing A-Z.

    ``separator`` marks the bytes (below 0x80) that end a word; texts end words too.
    """
    sep = separator[data]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    after = np.empty(len(data), bool)
    if len(data):
        after[0] = True
        after[1:] = sep[:-1]
        after[filled] = True
    starts = np.flatnonzero(after & ~sep)
    before = np.empty(len(data), bool)
    if len(data):
        before[:-1] = sep[1:]
        before[-1] = True
        before[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = True
    ends = np.flatnonzero(before & ~sep) + 1
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data].astype(np.uint64) * up[:len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    hashes = mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.searchsorted(starts, offsets)
    return hashes, starts, ends, first


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside texts, and where each text's run begins.

    A text of fewer words than ``width``, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    begin = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs, out=begin[1:])
    out = np.empty(begin[-1], np.uint64)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k:k + len(rolled)] * np.uint64(((k + 1) * 0x9FB21C651E98DF25 | 1) & (2**64 - 1))
    rolled = mix(rolled)
    long = counts >= width
    inside = np.repeat(first[:-1][long] - begin[:-1][long], runs[long]) + _positions(begin, long)
    out[_positions(begin, long)] = rolled[inside]
    for t in np.flatnonzero(~long & (counts > 0)):
        few = words[first[t]:first[t + 1]]
        h = np.array([len(few)], np.uint64)
        for k in range(len(few)):
            h = mix(h + few[k:k + 1])
        out[begin[t]] = h[0]
    return out, begin


def _positions(begin: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Positions begin[t]..begin[t+1]-1 of all chosen texts."""
    sizes = np.diff(begin)[chosen]
    if not len(sizes):
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(begin[:-1][chosen] - (ends - sizes), sizes)


def byte_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


WHITE_SPACE = byte_table(b" \t\n\v\f\r")
