"""Fixed-width vector files as a Spark data source that reads one file in many tasks.

``spark.read.format("vectors").option("kind", "vec1").load(path)`` reads a file or the files of a
folder, in order of their names. Kinds are ``vec1``, ``npy`` (two dimensions, C order), ``lbl1``,
``nbr1`` and ``spv1``; a split is a range of rows, whose bytes follow from the header alone. Rows have
no ids of their own: they are numbered from ``firstId`` (0) on, from one file to the next, so vectors
added later go on where a table ends.

``df.write.format("vectors").option("kind", "npy").save(folder)`` writes the vectors of the column
``embedding`` (``vec1`` and ``npy``), a file a task, named in order of partitions: sort the table by
range first, and reading gives its order back.

Paths are of any store that pyarrow's filesystems open (local, S3, GCS, HDFS). A header that doesn't
fit the file's size, another kind's file, an array in Fortran order or of other than numbers raise
``VectorError``; a file of no rows has none; vectors of two lengths in one task can't be written.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..errors import DimensionMismatch, Unsupported, VectorError

SCHEMAS = {
    "vec1": "vec_id long, embedding array<float>",
    "npy": "vec_id long, embedding array<double>",
    "lbl1": "vec_id long, label long",
    "nbr1": "query_id long, doc_id long, rank int",
    "spv1": "doc_id long, term long, weight double",
}
#: Rows of a split, and rows of a batch that a task makes at a time.
SPLIT, BATCH = 1 << 20, 1 << 12


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Layout:
    """Where a file's rows begin, how many there are, values a row and their kind."""

    start: int
    rows: int
    width: int
    dtype: str = "<f4"


def layout(kind: str, f: pa.NativeFile) -> Layout:
    size = f.size()
    if kind == "npy":
        head = io.BytesIO(f.read_at(min(size, 1 << 16), 0))
        try:
            version = np.lib.format.read_magic(head)
            shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
        except ValueError as e:
            raise VectorError(f"this isn't a NumPy file: {e}") from e
        if fortran or len(shape) != 2 or dtype.kind not in "fiu":
            raise VectorError(f"this array is of shape {shape}, {dtype}{', in Fortran order' if fortran else ''}; vectors are rows of numbers in C order")
        out = Layout(head.tell(), shape[0], shape[1], dtype.str)
        need = out.start + out.rows * out.width * dtype.itemsize
    else:
        numbers = {"vec1": 2, "nbr1": 2, "lbl1": 1, "spv1": 1}[kind]
        head = f.read_at(min(size, 16), 0)
        if head[:4] != kind.upper().encode() or len(head) < 4 + 4 * numbers:
            raise VectorError(f"this isn't a {kind.upper()} file")
        n, *more = np.frombuffer(head, "<u4", numbers, 4).astype(int).tolist()
        if kind == "spv1":
            out = Layout(16, n, int(np.frombuffer(f.read_at(8, 8), "<u8")[0]))
            need = 16 + 8 * (n + 1) + 8 * out.width
        else:
            out = Layout(4 + 4 * numbers, n, more[0] if more else 1, {"vec1": "<f4", "nbr1": "<i4", "lbl1": "<u4"}[kind])
            need = out.start + 4 * out.rows * out.width
    if size < need:
        raise VectorError(f"the header tells of {need} bytes, the file has {size}")
    return out


@dataclass
class Rows(InputPartition):
    path: str
    at: Layout
    first: int
    last: int
    number: int


class RangeReader(DataSourceReader):
    def __init__(self, kind: str, path: str, first_id: int, split: int):
        self.kind, self.path, self.first_id, self.split = kind, path, first_id, split

    def partitions(self) -> list[Rows]:
        fs, path = _open(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise VectorError(f"there is nothing at {self.path}")
        files = [path] if info.is_file else sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", ".")))
        out, number = [], self.first_id
        for p in files:
            with fs.open_input_file(p) as f:
                at = layout(self.kind, f)
            out += [Rows(p, at, i, min(i + self.split, at.rows), number + i) for i in range(0, at.rows, self.split)]
            number += at.rows
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, at, names = _open(self.path)[0], partition.at, [c.split()[0] for c in SCHEMAS[self.kind].split(", ")]
        with fs.open_input_file(partition.path) as f:
            for lo in range(partition.first, partition.last, BATCH):
                hi = min(lo + BATCH, partition.last)
                ids = np.arange(lo, hi, dtype=np.int64) - partition.first + partition.number
                yield pa.RecordBatch.from_arrays(self._columns(f, at, lo, hi, ids), names=names)

    def _columns(self, f: pa.NativeFile, at: Layout, lo: int, hi: int, ids: np.ndarray) -> list[pa.Array]:
        if self.kind == "spv1":
            edge = np.frombuffer(f.read_at(8 * (hi - lo + 1), at.start + 8 * lo), "<u8").astype(np.int64)
            terms = at.start + 8 * (at.rows + 1)
            n, m = int(edge[-1] - edge[0]), 4 * int(edge[0])
            term, weight = (np.frombuffer(f.read_at(4 * n, start + m), kind) for start, kind in ((terms, "<u4"), (terms + 4 * at.width, "<f4")))
            return [pa.array(np.repeat(ids, np.diff(edge))), pa.array(term.astype(np.int64)), pa.array(weight.astype(np.float64))]
        size = np.dtype(at.dtype).itemsize * at.width
        x = np.frombuffer(f.read_at(size * (hi - lo), at.start + size * lo), at.dtype)
        if self.kind == "lbl1":
            return [pa.array(ids), pa.array(x.astype(np.int64))]
        if self.kind == "nbr1":
            return [pa.array(np.repeat(ids, at.width)), pa.array(x.astype(np.int64)), pa.array(np.tile(np.arange(1, at.width + 1, dtype=np.int32), hi - lo))]
        x = x.astype(np.float32 if self.kind == "vec1" else np.float64)
        return [pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, at.width, dtype=np.int32) if at.width else np.zeros(hi - lo + 1, np.int32)), pa.array(x))]


@dataclass
class Written(WriterCommitMessage):
    path: str


class RangeWriter(DataSourceArrowWriter):
    """Tasks write under names that readers skip; the driver renames what the tasks that count wrote."""

    def __init__(self, kind: str, path: str, overwrite: bool):
        self.kind, self.path, self.overwrite, self.run = kind, path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"{path}/.{self.run}-{context.partitionId():06d}-{context.attemptNumber()}"
        n, width, kind = 0, None, "<f4" if self.kind == "vec1" else "<f8"
        with fs.open_output_stream(f"{name}.rows") as out:
            for b in iterator:
                if b.num_rows:
                    sizes = np.unique(b.column("embedding").value_lengths().to_numpy(zero_copy_only=False))
                    width = int(sizes[0]) if width is None else width
                    if len(sizes) > 1 or sizes[0] != width:
                        raise DimensionMismatch(width, int(sizes[-1]))
                    out.write(b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes())
                    n += b.num_rows
        head = io.BytesIO()
        if self.kind == "vec1":
            head.write(b"VEC1" + np.array([n, width or 0], "<u4").tobytes())
        else:
            np.lib.format.write_array_header_1_0(head, {"descr": kind, "fortran_order": False, "shape": (n, width or 0)})
        with fs.open_output_stream(f"{name}.{self.kind}") as out, fs.open_input_stream(f"{name}.rows") as rows:
            out.write(head.getvalue())
            while part := rows.read(1 << 20):
                out.write(part)
        fs.delete_file(f"{name}.rows")
        return Written(f"{name}.{self.kind}")

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pafs.FileSelector(path)):
                if old.is_file and not old.base_name.startswith((".", "_")):
                    fs.delete_file(old.path)
        taken = len([x for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and not x.base_name.startswith((".", "_"))])
        for i, m in enumerate(sorted(m.path for m in messages if m is not None)):
            fs.move(m, f"{path}/part-{taken + i:06d}.{self.kind}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def _kind(self) -> str:
        kind = self.options.get("kind", "vec1")
        if kind not in SCHEMAS:
            raise Unsupported(f"no vector files of kind {kind!r}; there are {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema) -> RangeReader:  # noqa: ANN001
        return RangeReader(self._kind(), self.options["path"], int(self.options.get("firstId", 0)), int(self.options.get("splitRows", SPLIT)))

    def writer(self, schema, overwrite: bool) -> RangeWriter:  # noqa: ANN001
        if self._kind() not in ("vec1", "npy"):
            raise Unsupported(f"{self._kind()} files aren't written")
        return RangeWriter(self._kind(), self.options["path"], overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Have a session know the format ``vectors``."""
    spark.dataSource.register(VectorFiles)
    return spark
