"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .hashing import mix
from .storage import process_cache, text_batches

MARK = "▁"  # stands for a space in pieces
_LITERAL = "\ud800"  # stands for MARK itself inside this module: no text can hold it
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 32, 48, 64)
FILTER_BITS = 22
CHUNK_CHARS, CELLS = 1 << 20, 50_000
_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


@dataclass
class Vocabulary:
    """Pieces by hash with their log weights, and the bytes that each id stands for."""

    hashes: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    filter: np.ndarray
    longest: int
    byte_ids: np.ndarray
    byte_weight: float
    flat: np.ndarray
    starts: np.ndarray
    steps: np.ndarray


def load(model_file: str, alpha: float = 1.0) -> Vocabulary:
    """Read a model. A piece's weight is (1 + rank) ** -alpha, its rank being the negative score of a BPE model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    names, byte_ids, places = [], np.zeros(256, np.int32), []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            places.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            places.append(b"")
        else:
            if "\n" in piece or MARK in piece.lstrip(MARK):
                raise ValueError("pieces must not hold line feeds, nor spaces behind their beginning")
            names.append((i, piece))
            places.append(piece.replace(MARK, " ").encode())
    if not byte_ids.any():
        raise ValueError("the model has no byte pieces")
    longest = max(len(p) for _, p in names)
    steps = mix(np.arange(1, longest + 1, dtype=np.uint64)) | np.uint64(1)
    hashes = np.array([mix(np.array([(np.array([ord(c) for c in p], np.uint64) * steps[:len(p)]).sum() + np.uint64(len(p))]))[0] for _, p in names])
    order = np.argsort(hashes)
    rank = np.array([-model.get_score(i) for i, _ in names])
    marks = np.zeros(1 << FILTER_BITS, bool)
    marks[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Vocabulary(hashes[order], np.array([i for i, _ in names], np.int32)[order], (-alpha * np.log1p(rank))[order], marks, longest,
                      byte_ids, float(-alpha * np.log1p(rank.max() + 1)), np.frombuffer(b"".join(places), np.uint8),
                      np.concatenate([[0], np.cumsum([len(p) for p in places])]), steps)


def _lattice(codes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(share, ids) of units in the rows of ``codes`` (0 beyond their end): the forward filter.

    share[u, i, l-1] is the chance that a piece of at most l characters ends at i, given that one ends there.
    """
    units, width = codes.shape
    most = min(width, v.longest)
    weight = np.full((units, width + 1, most), -np.inf)
    ids = np.zeros((units, width + 1, most), np.int32)
    rolled = np.zeros((units, width), np.uint64)
    big = codes.astype(np.uint64)
    for size in range(1, most + 1):
        rolled = rolled[:, :width - size + 1] + big[:, size - 1:] * v.steps[size - 1]
        h = mix(rolled + np.uint64(size))
        u, s = np.nonzero(v.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(v.hashes, h[u, s]), len(v.hashes) - 1)
        same = v.hashes[at] == h[u, s]
        u, s, at = u[same], s[same], at[same]
        weight[u, s + size, size - 1] = v.weights[at]
        ids[u, s + size, size - 1] = v.ids[at]
    u, s = np.nonzero((weight[:, 1:, 0] == -np.inf) & (codes > 0))  # characters without a piece: their bytes
    char = codes[u, s]
    length = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
    weight[u, s + 1, 0] = v.byte_weight * length
    ids[u, s + 1, 0] = -char.astype(np.int64) - 1
    forward = np.full((units, width + 1), -np.inf)
    forward[:, 0] = 0
    for i in range(1, width + 1):
        back = min(i, most)
        w = weight[:, i, :back]
        w += forward[:, i - 1::-1][:, :back] if i > 0 else 0
        top = w.max(axis=1)
        top[top == -np.inf] = 0
        np.exp(w - top[:, None], out=w)
        total = w.sum(axis=1)
        with np.errstate(divide="ignore"):
            forward[:, i] = np.log(total) + top
        np.cumsum(w, axis=1, out=w)
        w /= np.maximum(total, 1e-300)[:, None]
        weight[:, i, back:] = 1.0
    return weight, ids


def _sample(codes: np.ndarray, lengths: np.ndarray, unit: np.ndarray, seeds: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, step from the end, id) of sampled segmentations: the backward sampler.

    The random numbers of an occurrence come from its seed and the step alone.
    """
    share, ids = _lattice(codes, v)
    pos, live = lengths[unit].copy(), np.arange(len(unit))
    who, when, what, step = [], [], [], 0
    while len(live):
        u = unit[live]
        draw = (mix(seeds[live] + np.uint64((step + 1) * 0xA0761D6478BD642F & (2**64 - 1))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        at = pos[live]
        size = np.minimum((share[u, at] <= draw[:, None]).sum(axis=1), np.minimum(at, share.shape[2]) - 1)
        who.append(live)
        when.append(np.full(len(live), step))
        what.append(ids[u, at, size])
        pos[live] = at - size - 1
        live = live[pos[live] > 0]
        step += 1
    return np.concatenate(who), np.concatenate(when), np.concatenate(what)


def _bytes_of(char: int) -> bytes:
    return (MARK if char == ord(_LITERAL) else chr(char)).encode()


def encode(texts: list[str | None], keys: np.ndarray, v: Vocabulary, seed: int) -> list[np.ndarray]:
    """Sampled piece ids of each text; a text's ids depend on it, its key and ``seed`` alone."""
    found: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for n, text in enumerate(texts):
        if text:
            parts = _UNIT.findall(MARK + text.replace(MARK, _LITERAL).replace(" ", MARK))
            found += parts
            counts[n] = len(parts)
    names = list(dict.fromkeys(found))
    place = dict(zip(names, range(len(names))))
    unit = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(texts)), counts)
    turn = (np.arange(len(unit)) - np.repeat(ends - counts, counts)).astype(np.uint64)
    start = mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    seeds = mix(start[row] + turn * np.uint64(0xE7037ED1A0B428DB)) if len(unit) else np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    group = np.searchsorted(WIDTHS, lengths)
    group = np.where(group < len(WIDTHS), np.array(WIDTHS + (0,))[group], lengths)
    by_unit = np.argsort(unit, kind="stable")
    unit_starts = np.searchsorted(unit[by_unit], np.arange(len(names) + 1))
    who, when, what = [], [], []
    for width in np.unique(group):
        members = np.flatnonzero(group == width)
        for k in range(0, len(members), max(1, CELLS // int(width))):
            some = members[k:k + max(1, CELLS // int(width))]
            text = "".join([names[m].ljust(int(width), "\0") for m in some])
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), -1)
            sizes = unit_starts[some + 1] - unit_starts[some]
            local = np.repeat(np.arange(len(some)), sizes)
            e = np.cumsum(sizes)
            occurrence = by_unit[np.arange(e[-1]) + np.repeat(unit_starts[some] - (e - sizes), sizes)]
            o, s, i = _sample(codes, lengths[some], local, seeds[occurrence], v)
            who.append(occurrence[o])
            when.append(s)
            what.append(i)
    if not who:
        return [np.zeros(0, np.int32) for _ in texts]
    who, when, what = np.concatenate(who), np.concatenate(when), np.concatenate(what)
    pieces = np.bincount(who, minlength=len(unit))
    last = np.cumsum(pieces)
    flat = np.empty(len(who), np.int32)
    flat[last[who] - 1 - when] = what
    bounds = np.concatenate([[0], last])[np.concatenate([[0], ends])]
    flat, moved = _with_bytes(flat, v)
    bounds = moved[bounds]
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _with_bytes(flat: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """``flat`` with characters (-1 - code) replaced by the pieces of their bytes, and where each place has moved."""
    own = flat < 0
    chars, which = np.unique(-1 - flat[own], return_inverse=True)
    parts = [v.byte_ids[np.frombuffer(_bytes_of(int(c)), np.uint8)] for c in chars]
    lengths = np.array([len(p) for p in parts], np.int64)
    sizes = np.ones(len(flat), np.int64)
    sizes[own] = lengths[which]
    moved = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(moved[-1], np.int32)
    out[moved[:-1][~own]] = flat[~own]
    for k in range(lengths.max(initial=0)):
        longer = lengths[which] > k
        kth = np.array([p[k] if len(p) > k else 0 for p in parts], np.int32)
        out[moved[:-1][own][longer] + k] = kth[which[longer]]
    return out, moved


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text that ``encode`` was given, whatever segmentation it drew."""
    sizes = v.starts[ids + 1] - v.starts[ids]
    if not len(ids):
        return ""
    ends = np.cumsum(sizes)
    data = v.flat[np.arange(ends[-1]) + np.repeat(v.starts[ids] - (ends - sizes), sizes)]
    return data[1:].tobytes().decode()  # the first byte is the space that encoding puts before a text


def _vocabulary(model_file: str, alpha: float) -> Vocabulary:
    """A model is loaded once per worker process, as plain arrays that any later task may use."""
    loaded, name = process_cache("pieces"), f"pieces:{model_file}:{alpha}"
    if name not in loaded:
        loaded[name] = vars(load(model_file, alpha))
    return Vocabulary(**loaded[name])


def _chunks(texts: pd.Series, keys: pd.Series) -> Iterator[tuple[list[str | None], np.ndarray]]:
    size, start = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_CHARS or k == len(texts) - 1:
            yield texts.iloc[start:k + 1].tolist(), keys.iloc[start:k + 1].to_numpy()
            size, start = 0, k + 1


def encoded(docs: DataFrame, model_file: str, seed: int = 42, alpha: float = 1.0, key: str = "doc_id", out: str = "pieces") -> DataFrame:
    """Add ``out``: for each whole text the piece ids of one segmentation, drawn in proportion to its weight.

    The lattice of a text falls apart at spaces and line feeds, which pieces do not cross. Each
    distinct part has its forward weights computed once per batch; every occurrence is then
    sampled backwards with random numbers from ``seed``, the row's key, the part's place and the step. So
    a row is segmented alike in any batch or partition. Characters without a piece become byte
    pieces. ``model_file`` must exist on the executors. Null and empty texts have no pieces; a
    null key counts as -1. Rows and other columns stay; a column named ``out`` is replaced.
    """

    @F.pandas_udf("array<int>")
    def pieces(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        v = _vocabulary(model_file, alpha)
        for texts, keys in batches:
            ids = [x for some, k in _chunks(texts, keys) for x in encode(some, k, v, seed)]
            yield pd.Series(ids, dtype=object)

    text_batches(docs.sparkSession)
    return docs.withColumn(out, pieces(F.col("text").cast("string"), F.coalesce(F.col(key).cast("long"), F.lit(-1).cast("long"))))


def decoded(rows: DataFrame, model_file: str, alpha: float = 1.0, pieces: str = "pieces", out: str = "text") -> DataFrame:
    """Add ``out``: the texts of arrays of piece ids; null arrays have null texts."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = _vocabulary(model_file, alpha)
        for ids in batches:
            yield pd.Series([None if x is None else decode(np.asarray(x, np.int64), v) for x in ids], dtype=object)

    return rows.withColumn(out, texts(pieces))


def digests(ids: str = "pieces"):
    """The unsigned crc32 of ids as little-endian 32-bit numbers."""

    @F.pandas_udf("long")
    def crc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes()))

    return crc(ids)
