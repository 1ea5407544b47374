"""NumPy archives as Spark data sources: the driver reads headers only, and each task its own rows.

``csr_archive`` reads a .npz of a compressed sparse matrix (indptr, indices, data), ``dense_array`` a two-dimensional
.npy. Options: ``path``, and ``rows``, the rows of the matrix in one partition. The folder must be one that all
executors share. Members of a compressed archive are unpacked as a stream, so a task holds no more than its rows.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COUNTS = "cell_id long, gene_id int, cnt double"
ROWS = 4096


def _header(stream) -> tuple[tuple, np.dtype]:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(stream)
    if fortran and len(shape) > 1:
        raise ValueError("arrays in column order are not read")
    return shape, dtype


def member_shape(path: str, name: str) -> tuple:
    """The shape of a member of an archive, from its header."""
    with zipfile.ZipFile(path) as z, z.open(f"{name}.npy") as f:
        return _header(f)[0]


def member_slice(path: str, name: str, first: int, end: int) -> np.ndarray:
    """Values ``first`` to ``end`` of a one-dimensional member."""
    with zipfile.ZipFile(path) as z, z.open(f"{name}.npy") as f:
        _, dtype = _header(f)
        f.seek(first * dtype.itemsize, 1)
        return np.frombuffer(f.read((end - first) * dtype.itemsize), dtype)


def _batch(cells, genes, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(cells, np.int64)), pa.array(np.asarray(genes, np.int32)), pa.array(np.asarray(values, np.float64))], names=["cell_id", "gene_id", "cnt"])


class _Rows(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("rows", ROWS))

    def count(self) -> int:
        raise NotImplementedError

    def partitions(self):
        n = self.count()
        return [InputPartition((a, min(a + self.step, n))) for a in range(0, n, self.step)] or [InputPartition((0, 0))]


class _CsrReader(_Rows):
    def count(self) -> int:
        return member_shape(self.path, "indptr")[0] - 1

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        a, b = partition.value
        if b > a:
            ends = member_slice(self.path, "indptr", a, b + 1).astype(np.int64)
            genes, values = (member_slice(self.path, m, int(ends[0]), int(ends[-1])) for m in ("indices", "data"))
            yield _batch(np.repeat(np.arange(a, b), np.diff(ends)), genes, values)


class _DenseReader(_Rows):
    def count(self) -> int:
        shape = np.load(self.path, mmap_mode="r").shape
        if len(shape) != 2:
            raise ValueError("a dense count matrix has two dimensions")
        return shape[0]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        a, b = partition.value
        rows = np.load(self.path, mmap_mode="r")[a:b]
        r, c = np.nonzero(rows)
        yield _batch(a + r, c, rows[r, c])


class CsrArchive(DataSource):
    @classmethod
    def name(cls):
        return "csr_archive"

    def schema(self):
        return COUNTS

    def reader(self, schema):
        return _CsrReader(self.options)


class DenseArray(DataSource):
    @classmethod
    def name(cls):
        return "dense_array"

    def schema(self):
        return COUNTS

    def reader(self, schema):
        return _DenseReader(self.options)


def register(spark) -> None:
    for source in (CsrArchive, DenseArray):
        spark.dataSource.register(source)
