"""Whole blocks of an array's payload at NumPy speed: partial aggregates and file-to-file transforms.

Rows are the unit of everything else here; a reduction or a transform of all items of a plain numeric file needs
none, so these run on the bytes and give the JVM one row per block.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Errors, NdError
from ..workers import importable
from .dtypes import DType, numpy_dtype, parse_typestr, with_layout
from .files import locate, open_file
from .header import Header, header_bytes, read_header

#: Bytes of a block: what a task has in memory at once, and the unit of parallel work.
BLOCK_BYTES = 16 << 20


def _spans(spark: SparkSession, header: Header, block_bytes: int) -> DataFrame:
    """(begin, end) of the blocks, in enough partitions for all cores and at most one per block."""
    step = max(1, block_bytes // max(1, header.dtype.item_size))
    blocks = -(-header.size // step)
    rows = spark.range(0, blocks, 1, max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism, 100_000)))
    return rows.select((F.col("id") * step).alias("begin"), F.least((F.col("id") + 1) * step, F.lit(header.size)).alias("end"))


def _header(path: str) -> Header:
    stream, size = open_file(path)
    with stream:
        return read_header(stream, size)


def _block_reader(path: str, header: Header) -> Callable[[int, int], np.ndarray]:
    """Items begin to end of a file: a view of a map for local files, else bytes that are read."""
    dtype, item = numpy_dtype(header.dtype), header.dtype.item_size
    fs, at = locate(path)
    if fs.type_name == "local":
        whole = np.memmap(at, dtype, "r", header.data_offset, (header.size,)) if header.size else np.zeros(0, dtype)
        return lambda begin, end: whole[begin:end]
    stream = fs.open_input_file(at)
    return lambda begin, end: np.frombuffer(stream.read_at((end - begin) * item, header.data_offset + begin * item), dtype)


def summarize(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(n, n_nan, low, high, total) of a file of integers or floats: one row, from one row per block.

    low and high leave NaN out and are null without other items. For integers they and the total are exact
    (decimal(38,0)), for floats double.
    """
    importable(spark)
    header = _header(path)
    if header.dtype.fields or header.dtype.shape or header.dtype.code not in "iufb?":
        raise NdError(Errors.unavailable, f"no summary of {header.dtype.typestr}")
    is_float = header.dtype.code == "f"
    kind = "double" if is_float else "decimal(38,0)"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, rows = _block_reader(path, header), []
        for batch in batches:
            for begin, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = read(begin, end)
                if is_float:
                    low, high = (float(v) for v in (np.fmin.reduce(x), np.fmax.reduce(x)))
                    nan = int(np.isnan(x).sum()) if np.isnan(x.sum(dtype=np.float64)) else 0
                    total = float((np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf) if nan else x).sum(dtype=np.float64))
                    rows.append((end - begin, nan, None if np.isnan(low) else low, None if np.isnan(high) else high, total))
                else:
                    parts = [int(p.sum(dtype=np.uint64 if x.dtype.kind == "u" else np.int64)) for p in np.array_split(x, max(1, -(-len(x) >> 20)))] if x.dtype.itemsize < 8 else [int(np.right_shift(x, 32).sum(dtype=np.int64)) * (1 << 32) + int(np.bitwise_and(x, 0xFFFFFFFF).astype(np.uint64).sum(dtype=np.uint64))]
                    rows.append((end - begin, 0, Decimal(int(x.min())), Decimal(int(x.max())), Decimal(sum(parts))))
        value = pa.float64() if is_float else pa.decimal128(38, 0)
        types = [pa.int64(), pa.int64(), value, value, value]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["n", "n_nan", "low", "high", "total"])

    parts = _spans(spark, header, block_bytes).mapInArrow(run, f"n long, n_nan long, low {kind}, high {kind}, total {kind}")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_nan"), F.lit(0)).alias("n_nan"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").cast(kind).alias("total"))


def transform_file(spark: SparkSession, source: str, target: str, f: Callable[[np.ndarray], np.ndarray], typestr: str | None = None, overwrite: bool = False, block_bytes: int = BLOCK_BYTES) -> str:
    """Write f of all items of source as target, block by block in parallel, shape and order kept.

    f maps an array to one of the same length (NdError 404 else) whose type is that of source, or typestr. Blocks go
    to their places in a file that gets its name at the end, so a task that runs again does no harm.
    """
    target = target.removeprefix("file://")
    if os.path.exists(target) and not overwrite:
        raise NdError(Errors.file_exists, target)
    importable(spark)
    header = _header(source)
    dt: DType = with_layout(parse_typestr(typestr)) if typestr else header.dtype
    head, out_type = header_bytes(dt, header.fortran_order, header.shape), numpy_dtype(dt)
    part = f"{target}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "wb") as out:
            out.write(head)
            out.truncate(len(head) + header.size * dt.item_size)
        start = len(head)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read, done = _block_reader(source, header), 0
            with open(part, "r+b", buffering=0) as out:
                for batch in batches:
                    for begin, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        y = np.ascontiguousarray(np.asarray(f(read(begin, end))).astype(out_type, copy=False))
                        if len(y) != end - begin:
                            raise NdError(Errors.item_size_mismatch, f"{len(y)} values for {end - begin}")
                        out.seek(start + begin * dt.item_size)
                        out.write(memoryview(y).cast("B"))
                        done += len(y)
            yield pa.RecordBatch.from_arrays([pa.array([done])], names=["n"])

        written = _spans(spark, header, block_bytes).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
        if written != header.size:
            raise NdError(Errors.file_write_failed, f"{written} of {header.size} items")
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return target
