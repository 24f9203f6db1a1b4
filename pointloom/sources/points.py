"""PLY and PCD as Spark data sources, and a façade that chooses by extension."""

from __future__ import annotations

import io
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import formats

EXTENSIONS = ("ply", "pcd")
BATCH_ROWS = 100_000


def _fs(path: str):
    from pyarrow import fs

    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def _files(path: str, ext: str) -> list[str]:
    from pyarrow import fs

    system, at = _fs(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return [prefix + i.path for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and i.path.lower().endswith("." + ext)]


def _open(path: str):
    system, at = _fs(path)
    return io.BufferedReader(system.open_input_file(at))  # arrow's own handles read no lines


def _flag(options, name: str) -> bool:
    return str(options.get(name, "true")).lower() != "false"


@dataclass
class _File(InputPartition):
    frame: int
    path: str


class _Points(DataSource):
    ext = ""

    @classmethod
    def name(cls) -> str:
        return cls.ext

    def _header(self, f) -> formats.Header:
        return formats.ply_header(f) if self.ext == "ply" else formats.pcd_header(f)

    def _paths(self) -> list[str]:
        paths = _files(self.options["path"], self.ext)
        if not paths:
            raise FileNotFoundError(f"no .{self.ext} file under {self.options['path']}")
        return paths

    def schema(self) -> StructType:
        """frame_id, point_id, x, y, z and, as the first file's header has them, r, g, b, a and intensity."""
        with _open(self._paths()[0]) as f:
            h = self._header(f)
        names = ["x", "y", "z", *("rgba" if h.rgb and _flag(self.options, "rgb") else ()), *(["intensity"] if h.intensity and _flag(self.options, "intensity") else [])]
        return StructType([StructField("frame_id", LongType()), StructField("point_id", LongType()), *(StructField(n, DoubleType()) for n in names)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self, overwrite)


class PlySource(_Points):
    ext = "ply"


class PcdSource(_Points):
    ext = "pcd"


class _Reader(DataSourceReader):
    """A partition for each file."""

    def __init__(self, source: _Points, schema: StructType):
        self.source, self.names = source, [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [_File(k, p) for k, p in enumerate(self.source._paths())]

    def read(self, partition: _File):
        with _open(partition.path) as f:
            h = self.source._header(f)
            cols = formats.read_columns(f, h, "r" in self.names, "intensity" in self.names)
        n = len(cols["x"])
        cols |= {"frame_id": np.full(n, partition.frame, np.int64), "point_id": np.arange(n, dtype=np.int64)}
        for a in range(0, n, BATCH_ROWS):
            size = min(BATCH_ROWS, n - a)
            arrays = [pa.array(cols[c][a : a + size]) if c in cols else pa.nulls(size, pa.float64()) for c in self.names]
            yield pa.RecordBatch.from_arrays(arrays, names=self.names)


@dataclass
class _Done(WriterCommitMessage):
    temporary: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """A file for each task that has points, under a temporary name until the job commits. With option
    single, the one file takes the path itself."""

    def __init__(self, source: _Points, overwrite: bool):
        o = source.options
        self.ext, self.path, self.overwrite = source.ext, o["path"], overwrite
        self.ascii, self.single = str(o.get("ascii", "false")).lower() == "true", str(o.get("single", "false")).lower() == "true"

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(iterator)) if (first := next(iterator, None)) is None else pa.Table.from_batches([first, *iterator])
        cols = {c: table.column(c).to_numpy() for c in table.column_names if c in ("x", "y", "z", "r", "g", "b", "intensity")}
        system, at = _fs(self.path)
        folder = os.path.dirname(at) if self.single else at
        system.create_dir(folder, recursive=True)
        t = TaskContext.get()
        temporary = f"{folder}/.tmp-{t.partitionId()}-{t.taskAttemptId()}.{self.ext}"
        with system.open_output_stream(temporary) as f:
            (formats.write_ply if self.ext == "ply" else formats.write_pcd)(f, cols, self.ascii)
        return _Done(temporary, table.num_rows)

    def commit(self, messages) -> None:
        system, at = _fs(self.path)
        done = [m for m in messages if m is not None]
        if self.single and len(done) != 1:
            raise ValueError("a single file needs a single partition")
        for k, m in enumerate(done):
            system.move(m.temporary, at if self.single else f"{at}/part-{k:05d}.{self.ext}")

    def abort(self, messages) -> None:
        system, _ = _fs(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.temporary)


def register(spark: SparkSession) -> None:
    for s in (PlySource, PcdSource):
        spark.dataSource.register(s)


def _extension(path: str) -> str:
    ext = os.path.splitext(path)[1].lower().lstrip(".")
    if ext not in EXTENSIONS:
        raise ValueError(f"unsupported extension {ext!r}")
    return ext


def read_file(spark: SparkSession, path: str, rgb: bool = True, intensity: bool = True) -> DataFrame:
    """Points of a .ply or .pcd file; columns that are not wanted are not read."""
    register(spark)
    return spark.read.format(_extension(path)).option("rgb", rgb).option("intensity", intensity).load(path)


def write_file(df: DataFrame, path: str, ascii: bool = False, format: str | None = None) -> str:
    """Writes one file and returns its path, with the extension if it had none. Points that are not
    finite are left out; a set without any valid point is an error."""
    ext = format or _extension(path)
    if not path.lower().endswith("." + ext):
        path += "." + ext
    if not df.limit(1).count():
        raise ValueError("the point set is empty")
    register(df.sparkSession)
    df.coalesce(1).write.format(ext).option("ascii", ascii).option("single", True).mode("append").save(path)
    return path


def write_ply(df: DataFrame, path: str, ascii: bool = False) -> str:
    return write_file(df, path, ascii, "ply")


def write_pcd(df: DataFrame, path: str, ascii: bool = False) -> str:
    return write_file(df, path, ascii, "pcd")
