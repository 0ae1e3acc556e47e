"""Headers of many files as rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import Errors, NdError, Warnings
from ..workers import importable
from .dtypes import field_rows, serialize_descr
from .files import array_name, expand, open_archive, open_entry, open_file
from .header import Header, header_text, read_header

DDL = "path string, array_name string, version string, data_offset long, data_size long, descr string, item_size long, fortran_order boolean, shape array<long>, size long, header string, warnings int, error_code int"


def _row(path: str, name: str | None, total: int, header: Header | None, error: int) -> dict:
    out = dict.fromkeys((c.split()[0] for c in DDL.split(", ")))
    out |= {"path": path, "array_name": name, "warnings": 0, "error_code": error}
    if header:
        out |= {"version": "%d.%d" % header.version, "data_offset": header.data_offset, "data_size": total - header.data_offset, "descr": serialize_descr(header.dtype), "item_size": header.dtype.item_size}
        out |= {"fortran_order": header.fortran_order, "shape": list(header.shape), "size": header.size, "header": header_text(header.dtype, header.fortran_order, header.shape), "warnings": int(header.warnings)}
    return out


def describe(path: str, lenient: bool = False) -> list[dict]:
    """Rows for a .npy file or for each entry of a .npz archive; errors become codes."""

    def one(name, opened):
        try:
            stream, total = opened()
            with stream:
                return _row(path, name, total, read_header(stream, total, lenient), 0)
        except NdError as e:
            return _row(path, name, 0, None, int(e.code))

    if not path.endswith(".npz"):
        return [one(None, lambda: open_file(path))]
    try:
        with open_archive(path) as archive:
            names = archive.namelist()
    except NdError as e:
        return [_row(path, None, 0, None, int(e.code))]
    return [one(array_name(n), lambda n=n: open_entry(path, n)) for n in names]


def npy_catalog(spark: SparkSession, paths: list[str] | DataFrame, lenient: bool = False) -> DataFrame:
    """A row per array: what its header says, or the code of the error that reading it gives.

    paths: files and folders, or a DataFrame with a column path where there are too many to list. Only headers are
    read, in parallel.
    """
    importable(spark)
    if not isinstance(paths, DataFrame):
        files = []
        for p in paths:
            try:
                files += sorted({*expand(p, ".npy"), *expand(p, ".npz")})
            except NdError:
                files.append(p)
        paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), 64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
        for batch in batches:
            rows = [r for p in batch.column(0).to_pylist() for r in describe(p, lenient)]
            columns = [c.split() for c in DDL.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[t]) for n, t in columns], names=[n for n, _ in columns])

    return paths.select("path").mapInArrow(run, DDL)


def inspect_fields(spark: SparkSession, path: str, entry: str | None = None) -> DataFrame:
    """(path, type, offset, item_size, end) of every field of a structured array."""
    stream, total = open_entry(path, entry) if entry else open_file(path)
    with stream:
        header = read_header(stream, total)
    return spark.createDataFrame(field_rows(header.dtype), "path string, type string, offset long, item_size long, end long")


def read_properties(path: str, accept=lambda header: True) -> Header | None:
    """The header of a file, or None if accept(header) is false: a scan that is not wanted reads no payload."""
    stream, total = open_file(path)
    with stream:
        header = read_header(stream, total)
    return header if accept(header) else None


__all__ = ["Errors", "Warnings", "describe", "inspect_fields", "npy_catalog", "read_properties"]
