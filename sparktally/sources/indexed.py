"""Python data sources that read parts of files: tables of lines by a line index, and point clouds by chunks.

Files are opened through pyarrow's file systems, on the executors, wherever pyarrow reaches (local paths, s3://, gs://, hdfs://).
The driver lists names and sizes, and passes once over a line index; no content goes through it.
"""

from __future__ import annotations

import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def opened(path: str) -> pa.NativeFile:
    """A file for random access; tests count what is read through it."""
    fs, name = located(path)
    return fs.open_input_file(name)


def listed(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of one file, or of all files with these endings in a folder, by name."""
    fs, name = located(path)
    scheme = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(name, recursive=True)) if info.type == pafs.FileType.Directory else []
    return sorted((scheme + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(endings))


# ------------------------------------------------------------------------------------------------- lines by an index


@dataclass
class Lines(InputPartition):
    """Lines ``first`` to ``first + n`` of a table, whose offsets lie in the index at bytes ``start`` to ``stop``."""

    first: int
    n: int
    start: int
    stop: int


@dataclass
class Wanted:
    """What the filters that were pushed down ask for."""

    least: int = 0
    most: int | None = None
    rows: set[int] | None = None
    keys: set[str] | None = None

    def add(self, f: Filter) -> bool:
        """Takes a filter on ``row`` or ``key``; False if it has to be applied later."""
        name, value = ".".join(f.attribute) if hasattr(f, "attribute") else "", getattr(f, "value", None)
        if isinstance(f, (EqualTo, In)) and name in ("row", "key") and value is not None:
            values = {v for v in (value if isinstance(f, In) else [value]) if v is not None}
            old = self.rows if name == "row" else self.keys
            setattr(self, "rows" if name == "row" else "keys", values if old is None else old & values)
            return True
        if name == "row" and value is not None and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.least = max(self.least, value + isinstance(f, GreaterThan))
            return True
        if name == "row" and value is not None and isinstance(f, (LessThan, LessThanOrEqual)):
            top = value - isinstance(f, LessThan)
            self.most = top if self.most is None else min(self.most, top)
            return True
        return False

    def row(self, i: int) -> bool:
        return i >= self.least and (self.most is None or i <= self.most) and (self.rows is None or i in self.rows)

    def some(self, first: int, n: int) -> bool:
        if first + n <= self.least or (self.most is not None and first > self.most):
            return False
        return self.rows is None or any(first <= i < first + n for i in self.rows)


class LinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"]
        self.index = options.get("index") or posixpath.splitext(self.path)[0] + ".lineidx"
        self.part = int(options.get("rowsperpartition", 100_000))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.add(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        """One pass over the index, a buffer at a time; only every ``rowsPerPartition``-th place in it is kept."""
        out, at, row, starts, last = [], 0, 0, [0], b"\n"
        with opened(self.index) as f:
            while chunk := f.read(1 << 20):
                ends = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10)
                for k in range((-row - 1) % self.part, len(ends), self.part):
                    starts.append(at + int(ends[k]) + 1)
                row, at, last = row + len(ends), at + len(chunk), chunk[-1:]
        n = row + (last != b"\n")
        for k, start in enumerate(starts):
            first = k * self.part
            many = min(self.part, n - first)
            if many > 0 and self.wanted.some(first, many):
                out.append(Lines(first, many, start, starts[k + 1] if k + 1 < len(starts) else at))
        return out or [Lines(0, 0, 0, 0)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        if not partition.n:
            return
        with opened(self.index) as f:
            f.seek(partition.start)
            # the next line's offset ends the last one
            offsets = [int(x) for x in (f.read(partition.stop - partition.start) + f.read(32)).split()[: partition.n + 1]]
        with opened(self.path) as f:
            if len(offsets) == partition.n:
                offsets.append(f.size())
            for i in range(partition.n):
                row = partition.first + i
                if not self.wanted.row(row):
                    continue
                at, end, head = offsets[i], offsets[i + 1], b""
                f.seek(at)
                if self.wanted.keys is not None:  # a row's key is read alone first
                    while b"\t" not in head and at + len(head) < end:
                        head += f.read(min(64, end - at - len(head)))
                    if head.split(b"\t", 1)[0].strip().decode() not in self.wanted.keys:
                        continue
                columns = [c.strip() for c in (head + f.read(end - at - len(head))).decode().split("\t")]
                yield row, columns[0], columns[1:]


class IndexedLines(DataSource):
    """``spark.read.format("indexed_lines").load(path)``: (row, key, columns) of a table of lines with a line index.

    The index is a text file of each line's first byte, ``<name>.lineidx`` unless the option ``index`` names it. Filters on
    ``row`` choose the byte ranges that are read; with one on ``key`` a line is read up to its first tab unless it is asked
    for. Filters are pushed down where spark.sql.python.filterPushdown.enabled is set. An empty index: no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "indexed_lines"

    def schema(self) -> str:
        return "row long, key string, columns array<string>"

    def reader(self, schema: object) -> DataSourceReader:
        return LinesReader(dict(self.options))


def write_line_index(path: str, index: str | None = None) -> None:
    """Writes the line index of one file, read a buffer at a time; run it in a task of its own for large files."""
    fs, name = located(index or posixpath.splitext(path)[0] + ".lineidx")
    with opened(path) as f, fs.open_output_stream(name) as out:
        at, size = 0, f.size()
        if size:
            out.write(b"0\n")
        while chunk := f.read(1 << 20):
            ends = np.flatnonzero(np.frombuffer(chunk, np.uint8) == 10) + at + 1
            out.write("".join(f"{x}\n" for x in ends.tolist() if x < size).encode())
            at += len(chunk)


# ------------------------------------------------------------------------------------------------- point clouds

PLY_KINDS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
KEYS = ("points", "xyz")


@dataclass
class Share(InputPartition):
    """Share ``k`` of ``of`` of a file's points."""

    path: str
    k: int
    of: int


@dataclass
class Header:
    """A PLY file's vertices: where they begin, how many, in which format and with which columns."""

    form: str = "ascii"
    n: int = 0
    size: int = 0
    columns: list[tuple[str, str]] = field(default_factory=list)


def ply_header(f: pa.NativeFile) -> Header:
    out, head, element = Header(), b"", ""
    while b"end_header" not in head or b"\n" not in head[head.index(b"end_header") :]:
        more = f.read(4096)
        if not more:
            raise ValueError("a PLY file needs a header")
        head += more
    out.size = head.index(b"\n", head.index(b"end_header")) + 1
    first = True
    for line in head[: out.size].decode("latin-1").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            out.form = w[1]
        elif w[:1] == ["element"]:
            if first and w[1] != "vertex" and int(w[2]):
                raise ValueError("vertices have to come first in a PLY file")
            element, first = w[1], False
            out.n = int(w[2]) if element == "vertex" else out.n
        elif w[:1] == ["property"] and element == "vertex":
            if w[1] == "list":
                raise ValueError("lists of a vertex aren't read")
            out.columns.append((w[2], PLY_KINDS[w[1]]))
    return out


def ply_points(f: pa.NativeFile, k: int, of: int, chunk: int) -> Iterator[tuple[int, np.ndarray]]:
    head = ply_header(f)
    a, b = head.n * k // of, head.n * (k + 1) // of
    if head.form == "ascii":
        at = [[c for c, _ in head.columns].index(c) for c in "xyz"]
        f.seek(head.size)
        row, rest = 0, b""
        while row < b and (more := f.read(1 << 20)) or rest:
            lines = (rest + more).split(b"\n")
            rest = lines.pop() if more else b""
            lines = [x for x in lines if x.strip()]
            own = lines[max(0, a - row) : max(0, b - row)]
            if own:
                yield max(a, row), np.array([[float(x.split()[c]) for c in at] for x in own])
            row += len(lines)
            if not more:
                break
        return
    kind = np.dtype([(c, ("<" if head.form == "binary_little_endian" else ">") + t) for c, t in head.columns])
    for i in range(a, b, chunk):
        f.seek(head.size + i * kind.itemsize)
        rows = np.frombuffer(f.read(min(chunk, b - i) * kind.itemsize), kind)
        yield i, np.stack([rows[c].astype(float) for c in "xyz"], axis=1)


def npz_points(f: pa.NativeFile, k: int, of: int, chunk: int) -> Iterator[tuple[int, np.ndarray]]:
    with zipfile.ZipFile(f) as z:
        names = {n.removesuffix(".npy") for n in z.namelist()}
        key = next((x for x in KEYS if x in names), None)
        if key is None:
            raise ValueError("an npz file of points holds an array 'points' or 'xyz'")
        with z.open(f"{key}.npy") as member:
            version = np.lib.format.read_magic(member)
            shape, columns_first, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)
            if kind.hasobject or len(shape) != 2 or shape[1] < 3:
                raise ValueError("points are rows of three numbers or more")
            n, width = shape
            a, b = n * k // of, n * (k + 1) // of
            start, size = member.tell(), kind.itemsize
            if not columns_first:
                for i in range(a, b, chunk):
                    member.seek(start + i * width * size)  # a compressed member is read up to there
                    yield i, np.frombuffer(member.read(min(chunk, b - i) * width * size), kind).reshape(-1, width)[:, :3].astype(float)
            else:  # a column after the other: each is sought by itself
                for i in range(a, b, chunk):
                    parts = []
                    for c in range(3):
                        member.seek(start + (c * n + i) * size)
                        parts.append(np.frombuffer(member.read(min(chunk, b - i) * size), kind))
                    yield i, np.stack(parts, axis=1).astype(float)


class CloudReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.share = options["path"], int(options.get("bytesperpartition", 32 << 20))
        self.chunk = int(options.get("pointsperbatch", 65_536))

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path, (".npz", ".ply"))
        return [Share(p, k, of) for p, size in files for of in [max(1, -(-size // self.share))] for k in range(of)] or [Share("", 0, 0)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if not partition.of:
            return
        with opened(partition.path) as f:
            points = npz_points if partition.path.lower().endswith(".npz") else ply_points
            for first, xyz in points(f, partition.k, partition.of, self.chunk):
                i = np.arange(first, first + len(xyz), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(xyz), pa.string()), pa.array(i), *[pa.array(np.ascontiguousarray(xyz[:, c])) for c in range(3)]], names=["path", "i", "x", "y", "z"])


class PointClouds(DataSource):
    """``spark.read.format("point_clouds").load(path)``: (path, i, x, y, z) of npz and PLY files, one file or a folder.

    npz: the array ``points``, else ``xyz``, its first three columns. PLY: ASCII or binary. A large file is dealt out in shares of
    about ``bytesPerPartition``, and a share comes in batches of ``pointsPerBatch``, so a cloud is never one row or task.
    Files without points give no rows; no files: none.
    """

    @classmethod
    def name(cls) -> str:
        return "point_clouds"

    def schema(self) -> str:
        return "path string, i long, x double, y double, z double"

    def reader(self, schema: object) -> DataSourceReader:
        return CloudReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both known to the session."""
    for source in (IndexedLines, PointClouds):
        spark.dataSource.register(source)
