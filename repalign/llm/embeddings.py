"""Embedding near-duplicates: a subspace pigeonhole join of rotated vectors."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from .graph import connected_components
from .storage import kept, shuffle_parts
from .tiles import dealt, tiles_of

# Rows of either side of a tile: few where the table is small, so that all tasks get some, and more where it is large.
LEAST_ROWS, PART_ROWS = 1_500, 8_192
STRIP = 512  # rows compared at a time with the other side of their tile
_GROUP = ["label", "dim", "block", "x", "y"]


def _rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _rotated(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Unit vectors, rotated. Added up term by term: a vector's result doesn't depend on its company."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    turn, out = _rotation(unit.shape[1], seed), np.zeros_like(unit)
    for k in range(unit.shape[1]):
        out += unit[:, k:k + 1] * turn[k]
    return out


def _cuts(dim: int, blocks: int) -> list[tuple[int, int]]:
    """Blocks of near equal numbers of dimensions."""
    edges = [dim * b // blocks for b in range(blocks + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _allowance(dim: int, cut: tuple[int, int], threshold: float) -> float:
    """A block's part of the squared distance 2 - 2 * threshold, in proportion to its dimensions."""
    return (2 - 2 * threshold) * (cut[1] - cut[0]) / dim * (1 + 1e-9) + 1e-12


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _cells(blocks: int, threshold: float, seed: int, kind: type):
    """(key, label, dim, copies, v) -> a row for the cell of each block, and for half of the cells around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                rotated = _rotated(_matrix(rows.column(4), dim, kind), seed)
                for b, cut in enumerate(_cuts(int(dim), blocks)):
                    side = np.sqrt(_allowance(dim, cut, threshold))
                    x = np.floor(rotated[:, cut[0]] / side).astype(np.int32)
                    y = np.floor(rotated[:, cut[0] + 1] / side).astype(np.int32) if cut[1] - cut[0] > 1 else np.zeros_like(x)
                    for dx, dy in itertools.product((-1, 0, 1), repeat=2):
                        if (dx, dy) <= (0, 0) and (cut[1] - cut[0] > 1 or not dy):
                            n = rows.num_rows
                            yield pa.record_batch([*rows.columns, pa.array(np.full(n, b, np.int32)), pa.array(x + np.int32(dx)), pa.array(y + np.int32(dy)),
                                                   pa.array(np.full(n, (dx, dy) == (0, 0)))],
                                                  names=["key", "label", "dim", "copies", "v", "block", "x", "y", "home"])

    return run


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number that links (a, b) reach from each of 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _spread(cells: DataFrame, part_rows: int) -> DataFrame:
    """Add (tile_i, tile_j, left, right): each row at home in a cell meets every other row of that cell in one tile.

    Tile (i, j) compares part i of the rows at home, its left side, with part j of all rows, its right side. So the rows
    of cells around, four of five, go to the parts of those at home only, and never meet each other.
    """
    count = lambda rows: F.ceil(rows / F.lit(float(part_rows))).cast("int")
    sizes = cells.groupBy(*_GROUP).agg(count(F.count_if("home")).alias("lefts"), count(F.count(F.lit(1))).alias("rights")).where("lefts > 0")
    many = sizes.where("rights > 1")  # few: each has more than part_rows rows
    alone = F.struct(F.lit(0).alias("tile_i"), F.lit(0).alias("tile_j"))
    own_i, own_j = (F.pmod(F.xxhash64(F.lit(7), "key"), F.col(n)).cast("int") for n in ("lefts", "rights"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: F.struct(F.col("own_i").alias("tile_i"), j.alias("tile_j")))
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("tile_i"), F.col("own_j").alias("tile_j")))
    tiles = F.when(F.col("rights").isNull(), F.array(alone)).when(F.col("home"), F.array_union(as_left, as_right)).otherwise(as_right)
    placed = cells.join(F.broadcast(many), _GROUP, "left").withColumn("own_i", F.coalesce(own_i, F.lit(0))).withColumn("own_j", F.coalesce(own_j, F.lit(0)))
    return (placed.withColumn("tile", F.explode(tiles)).withColumn("left", F.col("home") & (F.col("tile.tile_i") == F.col("own_i")))
            .withColumn("right", F.col("tile.tile_j") == F.col("own_j")).select(*cells.columns, "tile.tile_i", "tile.tile_j", "left", "right"))


def _links(blocks: int, threshold: float, seed: int, kind: type):
    """Tiles -> kind 0: (key, links to copies of other vectors); kind 1: edges (a, b) that connect what links connect.

    A pair counts in the first block whose allowance it keeps, in the cell of one of the two, and of two rows at home
    in the tile where the smaller key is on the left.
    """
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles_of(batches, _GROUP):
            key, copies, home, left, right = (tile[c].to_numpy() for c in ("key", "copies", "home", "left", "right"))
            dim, block = tile["dim"][0].as_py(), tile["block"][0].as_py()
            cuts = _cuts(dim, blocks)
            near = [_allowance(dim, c, threshold) for c in cuts]
            lefts, rights = np.flatnonzero(left), np.flatnonzero(right)
            if not len(lefts) or not len(rights):
                continue
            v = _rotated(_matrix(tile["v"].combine_chunks(), dim, kind), seed)
            low, high = cuts[block]
            part_v = v[:, low:high]
            length = (part_v * part_v).sum(axis=1)
            other_v, other_length, other_key = part_v[rights], length[rights], np.where(home[rights], key[rights], np.iinfo(np.int64).max)
            degrees, roots = np.zeros(len(key)), np.arange(len(key))
            for s in range(0, len(lefts), STRIP):
                own = lefts[s:s + STRIP]
                far = length[own, None] + other_length - 2 * part_v[own] @ other_v.T
                may = far <= near[block] + 1e-9
                may &= key[own, None] < other_key
                a, b = np.nonzero(may)
                a, b = own[a], rights[b]
                found = []
                for k in range(0, len(a), 200_000):
                    i, j = a[k:k + 200_000], b[k:k + 200_000]
                    first = np.ones(len(i), bool)
                    for other, (lo, hi) in enumerate(cuts[:block + 1]):
                        d = v[i, lo:hi] - v[j, lo:hi]
                        close = (d * d).sum(axis=1) <= near[other]
                        first &= close if other == block else ~close
                    i, j = i[first], j[first]
                    real = (v[i] * v[j]).sum(axis=1) >= threshold
                    found.append((i[real], j[real]))
                if not sum(len(i) for i, _ in found):
                    continue
                a, b = (np.concatenate(side) for side in zip(*found))
                degrees += np.bincount(a, copies[b], len(key)) + np.bincount(b, copies[a], len(key))
                moved = np.flatnonzero(roots != np.arange(len(key)))
                roots = _roots(np.concatenate([a, moved]), np.concatenate([b, roots[moved]]), len(key))
            some, moved = np.flatnonzero(degrees), np.flatnonzero(roots != np.arange(len(key)))
            if len(some):
                yield pa.record_batch([pa.array([0] * len(some) + [1] * len(moved), pa.int32()), pa.array(np.concatenate([key[some], key[moved]])),
                                       pa.array(np.concatenate([degrees[some].astype(np.int64), key[roots[moved]]]))], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, blocks: int = 8, seed: int = 42) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not null and their cosine, in double precision, is at
    least ``threshold``. Unit vectors are rotated at random and cut into ``blocks`` low-dimensional
    blocks. Linked vectors differ by at most 2 - 2 * threshold in squared distance, so in some
    block by at most its part of that. For each block a grid over its first two dimensions joins
    each cell with its neighbours; pairs inside the block's allowance are verified exactly, each in the first
    such block. Cells of any size are cut into tiles. Tiles return link counts and connecting
    edges, never pairs.

    Equal vectors of a label are one node with a number of copies. Vectors that are null, empty, zero, or
    hold null or non-finite components have no links, nor have vectors of a null label; vectors of
    different length don't link. ``component_id`` is the smallest vec_id that links reach; null ids count as
    links but name no component, and are kept only if their component has no id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    parts = shuffle_parts(spark)
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType, ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else np.float64
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(usable, F.xxhash64("label", "embedding")))
    classes = kept(rows.where("key is not null").groupBy("key", "label", "embedding")
                   .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")

    code = np.dtype(kind).str

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.asarray(x, code) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([len(x) for x in v], pa.int32()), batch.column(3),
                                   pa.array([x.tobytes() for x in v], pa.binary())], names=["key", "label", "dim", "copies", "v"])

    columns = "key long, label long, dim int, copies long, v binary"
    nodes = classes.select("key", "embedding", "label", "copies").mapInArrow(packed, columns)
    cells = nodes.mapInArrow(_cells(blocks, threshold, seed, kind), columns + ", block int, x int, y int, home boolean")
    part_rows = min(PART_ROWS, max(LEAST_ROWS, 5 * blocks * classes.count() // (4 * parts)))
    tiles = dealt(_spread(cells, part_rows), _GROUP, parts)
    links = kept(tiles.mapInArrow(_links(blocks, threshold, seed, kind), "kind int, a long, b long"), "links")

    degrees = links.where("kind = 0").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("others"))
    roots = connected_components(links.where("kind = 1")).withColumnRenamed("node", "key")
    named = roots.join(classes.select("key", "rep").where("rep is not null"), "key").groupBy("root").agg(F.min("rep").alias("least"))
    labels = (classes.select("key", "rep", "copies").join(roots, "key", "left").join(named, "root", "left").join(degrees, "key", "left")
              .select("key", F.coalesce("least", "rep").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")))
    component = F.coalesce("component", "vec_id")
    return (rows.select("vec_id", "key").join(labels, "key", "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                    F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept")))
