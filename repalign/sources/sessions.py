"""Responses of whole sessions as a Spark data source: one .npy matrix (targets, trials) per subject, session, side and
range of targets (S5, S6, S17).

Files are packed into partitions by size. Subject, session and side, given as options or pushed down as filters, prune files before any
is opened; wanted targets are read by their place in the file, nothing else of it. Paths are whatever ``pyarrow.fs``
knows.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .tables import SCHEMAS

TARGETS_PER_FILE = 8192
CELLS_PER_BATCH = 1 << 18
SPLIT_BYTES, OPEN_BYTES = 32 << 20, 1 << 20  # of files in a partition, and what opening one costs in bytes
FILE_NAME = re.compile(r"(lh|rh)\.session(\d+)\.from(\d+)\.npy")
PRUNING = ("subject", "session", "hemi")


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class _File:
    path: str
    size: int
    subject: str
    session: int
    hemi: str
    first: int


@dataclass
class _Files(InputPartition):
    files: list[_File]


def session_files(path: str) -> list[_File]:
    """All files below a folder by name, none opened; a folder that is not there has none."""
    system, local = _system(path)
    found = system.get_file_info(fs.FileSelector(local, allow_not_found=True, recursive=True))
    out = []
    for f in sorted(found, key=lambda f: f.path):
        name = FILE_NAME.fullmatch(f.base_name)
        if name and f.type == fs.FileType.File:
            out.append(_File(f.path, f.size, unquote(f.path.split("/")[-2]), int(name[2]), name[1], int(name[3])))
    return out


class SessionReader(DataSourceReader):
    def __init__(self, path: str, wanted: dict[str, set], split: int) -> None:
        self.path, self.wanted, self.split = path, wanted, split

    def partitions(self) -> list[InputPartition]:
        packs, left = [], 0
        for f in session_files(self.path):
            if all(getattr(f, c) in self.wanted[c] for c in PRUNING if c in self.wanted):
                if left < f.size + OPEN_BYTES or not packs:
                    packs.append(_Files([]))
                    left = self.split
                packs[-1].files.append(f)
                left -= f.size + OPEN_BYTES
        return packs or [_Files([])]

    def read(self, pack: _Files) -> Iterator[pa.RecordBatch]:
        system = _system(self.path)[0]
        for part in pack.files:
            with system.open_input_file(part.path) as file:
                yield from self._cells(part, file)

    def _cells(self, part: _File, file: pa.NativeFile) -> Iterator[pa.RecordBatch]:
        head = io.BytesIO(file.read_at(min(file.size(), 4096), 0))
        version = np.lib.format.read_magic(head)
        shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
        if by_columns or len(shape) != 2:
            raise ValueError(f"not a matrix in row order: {part.path}")
        places = np.arange(shape[0])
        if "target_id" in self.wanted:
            places = places[np.isin(places + part.first, [t for t in self.wanted["target_id"] if t is not None])]
        step, width = max(1, CELLS_PER_BATCH // max(1, shape[1])), shape[1] * dtype.itemsize
        runs = np.split(places, np.flatnonzero(np.diff(places) != 1) + 1)
        for run in (r[k:k + step] for r in runs for k in range(0, len(r), step)):
            data = file.read_at(len(run) * width, head.tell() + int(run[0]) * width)
            cells = np.frombuffer(data, dtype).reshape(len(run), shape[1])
            row, trial = np.nonzero(~np.isnan(cells.astype(np.float64)))
            n = len(row)
            yield pa.RecordBatch.from_arrays([
                pa.repeat(pa.scalar(part.subject), n), pa.repeat(pa.scalar(part.session, pa.int32()), n), pa.array(trial.astype(np.int32)),
                pa.repeat(pa.scalar(part.hemi), n), pa.array((run[row] + part.first).astype(np.int32)),
                pa.array(cells[row, trial].astype(np.float64))], names=["subject", "session", "trial_in_session", "hemi", "target_id", "value"])


class FilteringReader(SessionReader):
    """The same with filters pushed down; Spark refuses such a reader where its setting is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and lists on subject, session, side and target are taken; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in (*PRUNING, "target_id") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f


class SessionSource(DataSource):
    """``session_responses``: options path, split (bytes of a partition), filters (``true`` where the session lets them be pushed down) and, as
    comma-separated lists, subjects, sessions and sides."""

    @classmethod
    def name(cls) -> str:
        return "session_responses"

    def schema(self) -> str:
        return SCHEMAS["session_betas"]

    def reader(self, schema) -> SessionReader:
        wanted = {}
        for column, option, kind in zip(PRUNING, ("subjects", "sessions", "sides"), (unquote, int, str)):
            if option in self.options:
                wanted[column] = {kind(v) for v in self.options[option].split(",") if v}
        kind = FilteringReader if self.options.get("filters") == "true" else SessionReader
        return kind(self.options["path"].rstrip("/"), wanted, int(self.options.get("split", SPLIT_BYTES)))


def read_sessions(spark: SparkSession, path: str, subjects: Iterable[str] | None = None, sessions: Iterable[int] | None = None,
                  sides: Iterable[str] | None = None, split: int = SPLIT_BYTES) -> DataFrame:
    """(subject, session, trial_in_session, hemi, target_id, value) of the wanted files (S5); an empty list wants none.

    Filters on these columns and on target_id prune as well where the session has
    spark.sql.python.filterPushdown.enabled; the setting is left as it is. Spark keeps pushed filters with the table that a
    read makes, for all that is derived from it: where that setting is on, read anew for each use with filters of its own.
    """
    spark.dataSource.register(SessionSource)
    pushing = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    reader = spark.read.format("session_responses").option("path", path).option("filters", pushing).option("split", split)
    if subjects is not None:
        reader = reader.option("subjects", ",".join(quote(s, safe="") for s in subjects))
    if sessions is not None:
        reader = reader.option("sessions", ",".join(str(s) for s in sessions))
    if sides is not None:
        reader = reader.option("sides", ",".join(sides))
    return reader.load()


def read_session_files(spark: SparkSession, path: str) -> DataFrame:
    """(subject, session, hemi) of the files there are, from their names alone."""
    found = sorted({(f.subject, f.session, f.hemi) for f in session_files(path)})
    return spark.createDataFrame(found, "subject string, session int, hemi string")


def write_sessions(df: DataFrame, path: str, targets_per_file: int = TARGETS_PER_FILE) -> int:
    """Write rows in the layout of ``read_sessions``; returns the number of files.

    A file holds all trials of a session for a range of targets, so a task holds no more. It is written under a name of
    its own and moved, so a task that runs again replaces it by the same. Null and NaN values are cells without a
    row when read. Of a cell given twice the larger value stays. Keys must not be null and sides are lh or rh; an empty
    table writes nothing.
    """
    path = path.rstrip("/")

    def save(key: tuple, table: pa.Table) -> pa.Table:
        subject, session, hemi, chunk = (k.as_py() for k in key)
        if hemi not in ("lh", "rh"):
            raise ValueError(f"unknown side: {hemi}")
        target, trial, value = (table[c].to_numpy() for c in ("target_id", "trial_in_session", "value"))
        first = chunk * targets_per_file
        cells = np.full((target.max() - first + 1, trial.max() + 1), np.nan)
        np.fmax.at(cells, (target - first, trial), value)
        system, local = _system(path)
        folder = f"{local}/{quote(subject, safe='')}"
        system.create_dir(folder, recursive=True)
        data, own = io.BytesIO(), f"{folder}/_{uuid.uuid4().hex}"
        np.save(data, cells)
        with system.open_output_stream(own) as out:
            out.write(data.getbuffer())
        final = f"{folder}/{hemi}.session{session:02d}.from{first}.npy"
        if system.get_file_info(final).type != fs.FileType.NotFound:
            system.delete_file(final)
        system.move(own, final)
        return pa.table({"files": pa.array([1], pa.int32())})

    rows = df.select("subject", "session", "hemi", F.floor(F.col("target_id") / targets_per_file).alias("chunk"), "target_id",
                     "trial_in_session", F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))
    return rows.groupBy("subject", "session", "hemi", "chunk").applyInArrow(save, "files int").count()
