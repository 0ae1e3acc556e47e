"""The data sources "npy" and "npz"."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import Errors, NdError
from ..workers import importable
from .decode import to_arrow
from .dtypes import DType, numpy_dtype, spark_type
from .files import array_name, expand, open_archive, open_entry, open_file
from .header import Header, read_header

LAYOUTS = ("items", "records", "rows", "raw")
#: Bytes of payload that one task reads, and that one Arrow batch holds.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


@dataclass
class Span(InputPartition):
    """Units begin to end of an array: items, or rows of the first axis."""

    path: str
    entry: str | None
    begin: int
    end: int


def header_of(path: str, entry: str | None, lenient: bool) -> Header:
    stream, size = open_entry(path, entry) if entry else open_file(path)
    with stream:
        return read_header(stream, size, lenient)


def layout_schema(header: Header, layout: str, fields: list[str] | None, named: bool) -> T.StructType:
    dt = header.dtype
    first = [T.StructField("array_name", T.StringType())] if named else []
    if layout == "raw":
        columns = [T.StructField("flat_index", T.LongType()), T.StructField("value", T.BinaryType())]
    elif layout == "rows":
        if header.fortran_order or not header.shape:
            raise NdError(Errors.unavailable, "rows need a row-major array of one axis at least")
        columns = [T.StructField("i0", T.LongType()), T.StructField("values", T.ArrayType(spark_type(dt)))]
    elif layout == "records":
        if not dt.is_structured:
            raise NdError(Errors.unavailable, "records need a structured array")
        made = spark_type(DType(fields=dt.fields))
        columns = [T.StructField("flat_index", T.LongType()), *(f for f in made.fields if fields is None or f.name in fields)]
    elif layout == "items":
        columns = [T.StructField("flat_index", T.LongType()), T.StructField("value", spark_type(dt))]
    else:
        raise NdError(Errors.invalid_value, f"layout {layout!r} is none of {LAYOUTS}")
    return T.StructType(first + columns)


class ArraySource(DataSource):
    """Options: path (a file or a folder of files of one type), layout (items, records, rows, raw), fields, lenient,
    partitionBytes, begin and end (a range of items, or of rows), and for archives arrays (names, by comma).

    Ranges and names are options, not pushed filters: Spark keeps what a Python reader was told to filter for all
    later queries over the same DataFrame, which would then miss rows.
    """

    suffix, named = ".npy", False

    def entries(self) -> list[tuple[str, str | None]]:
        return [(p, None) for p in expand(self.options["path"], self.suffix)]

    def header(self, path: str, entry: str | None) -> Header:
        return header_of(path, entry, self.options.get("lenient", "false") == "true")

    def schema(self) -> T.StructType:
        found = self.entries()
        if not found:
            raise NdError(Errors.file_not_found, self.options["path"])
        fields = [f.strip() for f in self.options["fields"].split(",")] if self.options.get("fields") else None
        return layout_schema(self.header(*found[0]), self.options.get("layout", "items"), fields, self.named)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrayReader(self, schema)


class NpySource(ArraySource):
    @classmethod
    def name(cls) -> str:
        return "npy"


class NpzSource(ArraySource):
    suffix, named = ".npz", True

    @classmethod
    def name(cls) -> str:
        return "npz"

    def entries(self) -> list[tuple[str, str | None]]:
        wanted = {n.strip() for n in self.options["arrays"].split(",")} if self.options.get("arrays") else None
        out = []
        for path in expand(self.options["path"], self.suffix):
            with open_archive(path) as archive:
                out += [(path, e) for e in archive.namelist() if wanted is None or array_name(e) in wanted]
        return out


class ArrayReader(DataSourceReader):
    def __init__(self, source: ArraySource, schema: T.StructType):
        self.source, self.names = source, schema.names
        self.layout = source.options.get("layout", "items")
        self.index = "i0" if self.layout == "rows" else "flat_index"
        self.low = int(source.options.get("begin", 0))
        self.high = int(source.options["end"]) if "end" in source.options else None

    def partitions(self) -> list[Span]:
        out, first = [], None
        budget = int(self.source.options.get("partitionBytes", PARTITION_BYTES))
        for path, entry in self.source.entries():
            header = self.source.header(path, entry)
            first = first or header
            if spark_type(header.dtype) != spark_type(first.dtype):
                raise NdError(Errors.descr_invalid_type, f"{entry or path} has another type than the first array; choose with arrays or path")
            units, each = self._units(header)
            low, high = self.low, units if self.high is None else min(units, self.high)
            step = max(1, budget // max(1, each))
            out += [Span(path, entry, b, min(b + step, high)) for b in range(low, high, step)]
        return out or [Span("", None, 0, 0)]

    def _units(self, header: Header) -> tuple[int, int]:
        if self.layout != "rows":
            return header.size, header.dtype.item_size
        rows = header.shape[0]
        return rows, header.dtype.item_size * (header.size // rows if rows else 1)

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span.begin >= span.end:
            return
        stream, size = open_entry(span.path, span.entry) if span.entry else open_file(span.path)
        with stream:
            header = read_header(stream, size, self.source.options.get("lenient", "false") == "true")
            _, each = self._units(header)
            _skip(stream, header.data_offset, span.begin * each, span.entry is None)
            step = max(1, BATCH_BYTES // max(1, each))
            for begin in range(span.begin, span.end, step):
                n = min(step, span.end - begin)
                data = stream.read(n * each)
                if len(data) < n * each:
                    raise NdError(Errors.file_truncated, span.path)
                yield self._batch(header, span, begin, n, data)

    def _batch(self, header: Header, span: Span, begin: int, n: int, data: bytes) -> pa.RecordBatch:
        made: dict[str, Any] = {self.index: pa.array(np.arange(begin, begin + n, dtype=np.int64))}
        if span.entry:
            made["array_name"] = pa.array([array_name(span.entry)] * n)
        dt = header.dtype
        if self.layout == "raw":
            size = dt.item_size
            offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * size).tobytes())
            made["value"] = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(data)])
        else:
            x = np.frombuffer(data, numpy_dtype(dt))
            if self.layout == "rows":
                per = len(x) // n
                made["values"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * per, pa.int32()), to_arrow(x, dt))
            elif self.layout == "records":
                made |= {f.name: to_arrow(x[f.name], f) for f in dt.fields if f.name in self.names}
            else:
                made["value"] = to_arrow(x, dt)
        return pa.RecordBatch.from_arrays([made[c] for c in self.names], names=self.names)


def _skip(stream, data_offset: int, count: int, seekable: bool) -> None:
    if seekable:
        stream.seek(data_offset + count)
        return
    while count:
        got = len(stream.read(min(count, 1 << 20)))
        if not got:
            raise NdError(Errors.file_truncated)
        count -= got


def register(spark: SparkSession) -> None:
    """Make "npy" and "npz" known to the session."""
    importable(spark)
    spark.dataSource.register(NpySource)
    spark.dataSource.register(NpzSource)


def read_npy(spark: SparkSession, path: str, layout: str = "items", **options) -> DataFrame:
    register(spark)
    return spark.read.format("npy").options(layout=layout, **options).load(path)


def read_npz(spark: SparkSession, path: str, layout: str = "items", **options) -> DataFrame:
    register(spark)
    return spark.read.format("npz").options(layout=layout, **options).load(path)


def find_array(archive: DataFrame, name: str, required: bool = False) -> DataFrame:
    """The rows of one array of an archive, without its name; with required, NdError 602 if it isn't there."""
    found = archive.filter(archive["array_name"] == name).drop("array_name")
    if required and found.isEmpty():
        raise NdError(Errors.index_out_of_bounds, f"no array {name!r}")
    return found
