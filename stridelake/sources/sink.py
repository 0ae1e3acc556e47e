"""Writing arrays: .npy files, folders of them, and .npz archives."""

from __future__ import annotations

import math
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Errors, NdError
from ..workers import importable
from .dtypes import DType, dtype_of, numpy_dtype, parse_typestr, with_layout
from .header import header_bytes


def to_numpy(column: pa.Array, dt: DType) -> np.ndarray:
    """A column as items of dt; NdError 601 for nulls, texts that are too long and lists of another length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise NdError(Errors.invalid_value, f"{dt.name or 'value'} holds nulls, which arrays don't have")
    if dt.shape:
        sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.array([])
        if (sizes != dt.shape[0]).any():
            raise NdError(Errors.invalid_value, f"{dt.name}: lists are not all of length {dt.shape[0]}")
        inner = to_numpy(column.flatten(), DType(dt.name, dt.order, dt.code, dt.size, dt.shape[1:], dt.fields))
        return inner.reshape(len(column), *dt.shape)
    if dt.fields:
        out = np.zeros(len(column), numpy_dtype(with_layout(dt)))
        for k, f in enumerate(dt.fields):
            out[f.name] = to_numpy(column.field(k), f)
        return out
    if dt.code == "U":
        texts = column.to_pylist()
        if any(len(t) > dt.size for t in texts):
            raise NdError(Errors.invalid_value, f"{dt.name}: a text is longer than {dt.size}")
        return np.array(texts, numpy_dtype(dt)) if texts else np.zeros(0, numpy_dtype(dt))
    if dt.code in "SV":
        raw = column.to_pylist()
        if any(len(b) > dt.size for b in raw):
            raise NdError(Errors.invalid_value, f"{dt.name}: bytes are longer than {dt.size}")
        return np.frombuffer(b"".join(b.ljust(dt.size, b"\0") for b in raw), numpy_dtype(dt))
    if dt.code == "c":
        out = np.empty(len(column), numpy_dtype(dt))
        out.real, out.imag = column.field(0).to_numpy(zero_copy_only=False), column.field(1).to_numpy(zero_copy_only=False)
        return out
    if pa.types.is_decimal(column.type):
        return np.array([int(v) for v in column.to_pylist()], numpy_dtype(dt))
    return column.to_numpy(zero_copy_only=False).astype(numpy_dtype(dt))


def _element(df: DataFrame, typestr: str | None, widths: dict[str, int] | None, shapes: dict[str, tuple[int, ...]] | None) -> tuple[DataFrame, DType]:
    """(flat_index, value) and the element type. All columns besides flat_index and value form a record."""
    rest = [c for c in df.columns if c != "flat_index"]
    value = F.col("value") if rest == ["value"] else F.struct(*rest)
    df = df.select(F.col("flat_index").cast("long"), value.alias("value"))
    if typestr:
        dt = parse_typestr(typestr)
    else:
        dt = _typed(df.schema["value"].dataType, "", widths, shapes or {}, ())
    return df, with_layout(dt)


def _typed(spark, name, widths, shapes, path) -> DType:
    from pyspark.sql import types as T

    path = (*path, name) if name else path
    if isinstance(spark, T.ArrayType):
        shape = shapes.get(".".join(path))
        if not shape:
            raise NdError(Errors.descr_list_invalid_shape, f"no shape for {'.'.join(path)}")
        inner = spark
        for _ in shape:
            inner = inner.elementType
        dt = _typed(inner, name, widths, shapes, path[:-1])
        return DType(name, dt.order, dt.code, dt.size, tuple(shape), dt.fields)
    if isinstance(spark, T.StructType) and [f.name for f in spark.fields] != ["re", "im"]:
        return DType(name, "|", "V", 0, (), tuple(_typed(f.dataType, f.name, widths, shapes, path) for f in spark.fields))
    return dtype_of(spark, name, widths, path[:-1] if name else path)


def _check_dense(df: DataFrame, n: int) -> None:
    """NdError 601 unless the indices are 0 to n - 1, each once; nothing is shuffled for it but sums."""
    mark = [F.count("*"), F.min("flat_index"), F.max("flat_index"), F.expr("bit_xor(xxhash64(flat_index))"), F.expr("sum(pmod(xxhash64(flat_index, 1), 1000003))")]
    got = df.agg(*mark).first()
    want = df.sparkSession.range(n).select(F.col("id").alias("flat_index")).agg(*mark).first()
    if tuple(got) != tuple(want):
        raise NdError(Errors.invalid_value, f"flat_index is not 0 to {n - 1} once each")


def save_npy(
    df: DataFrame,
    path: str,
    shape: tuple[int, ...] | None = None,
    typestr: str | None = None,
    fortran_order: bool = False,
    overwrite: bool = False,
    widths: dict[str, int] | None = None,
    shapes: dict[str, tuple[int, ...]] | None = None,
) -> str:
    """Write (flat_index, value) or (flat_index, fields...) as one .npy file; returns the path.

    The place of an item follows from its index, so every task writes its items to where they belong: no sort, no
    shuffle and no gathering of parts; a task that runs again writes the same bytes. The file gets its name when all
    are done. path must be on a file system that all executors mount. NdError 103 if it exists and not overwrite,
    601 if the indices are not dense or the shape has another size.
    """
    path = path.removeprefix("file://")
    if os.path.exists(path) and not overwrite:
        raise NdError(Errors.file_exists, path)
    importable(df.sparkSession)
    df, dt = _element(df, typestr, widths, shapes)
    n = math.prod(shape) if shape is not None else df.count()
    _check_dense(df, n)
    head = header_bytes(dt, fortran_order, (n,) if shape is None else tuple(shape))
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "wb") as f:
            f.write(head)
            f.truncate(len(head) + n * dt.item_size)
        start, item = len(head), dt.item_size

        def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = 0
            with open(part, "r+b") as f:
                for batch in batches:
                    index, values = batch.column(0).to_numpy(), to_numpy(batch.column(1), dt)
                    order = np.argsort(index, kind="stable")
                    index, values = index[order], values[order]
                    for run in np.split(np.arange(len(index)), np.nonzero(np.diff(index) != 1)[0] + 1):
                        if len(run):
                            f.seek(start + int(index[run[0]]) * item)
                            f.write(np.ascontiguousarray(values[run]).tobytes())
                    done += len(index)
            yield pa.RecordBatch.from_arrays([pa.array([done])], names=["n"])

        written = df.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
        if written != n:
            raise NdError(Errors.file_write_failed, f"{written} of {n} items")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return path


def _archive(path: str, arrays: list[tuple[str, DataFrame, dict]], method: int, level: int | None, overwrite: bool) -> str:
    path = path.removeprefix("file://")
    names = [n for n, _, _ in arrays]
    if len(set(names)) != len(names):
        raise NdError(Errors.duplicate_array_name, str(sorted({n for n in names if names.count(n) > 1})))
    if os.path.exists(path) and not overwrite:
        raise NdError(Errors.file_exists, path)
    work = f"{path}.{uuid.uuid4().hex}.parts"
    os.makedirs(work)
    try:
        with zipfile.ZipFile(f"{work}/archive", "w", method, compresslevel=level) as z:
            for k, (name, df, options) in enumerate(arrays):
                z.write(save_npy(df, f"{work}/{k}.npy", **options), f"{name}.npy")
                os.unlink(f"{work}/{k}.npy")
        os.replace(f"{work}/archive", path)
    except OSError as e:
        raise NdError(Errors.file_write_failed, str(e)) from None
    finally:
        shutil.rmtree(work, ignore_errors=True)
    return path


def _named(arrays) -> list[tuple[str, DataFrame, dict]]:
    pairs = arrays.items() if isinstance(arrays, dict) else arrays if arrays and isinstance(arrays[0], tuple) and isinstance(arrays[0][0], str) else [(f"arr_{k}", a) for k, a in enumerate(arrays)]
    return [(n, *(a if isinstance(a, tuple) else (a, {}))) for n, a in pairs]


def save_npz(path: str, arrays, overwrite: bool = False) -> str:
    """An archive of stored arrays. arrays: {name: df}, [(name, df)] or [df] (arr_0, arr_1, ...); for df also (df, options of save_npy)."""
    return _archive(path, _named(arrays), zipfile.ZIP_STORED, None, overwrite)


def save_npz_compressed(path: str, arrays, overwrite: bool = False, level: int = 0) -> str:
    """save_npz with deflated entries; level 0: the default level, 1 to 9: zlib's."""
    return _archive(path, _named(arrays), zipfile.ZIP_DEFLATED, level or None, overwrite)


def save_npy_shards(df: DataFrame, folder: str, overwrite: bool = False, **options) -> str:
    """A folder of .npy files, one for each partition of df, for arrays too large for one file; indices restart in each.

    Reading the folder gives all items; the order of the files is that of the partitions.
    """
    folder = folder.removeprefix("file://")
    if os.path.exists(folder):
        if not overwrite:
            raise NdError(Errors.file_exists, folder)
        shutil.rmtree(folder)
    importable(df.sparkSession)
    df, dt = _element(df, options.get("typestr"), options.get("widths"), options.get("shapes"))
    work = f"{folder}.{uuid.uuid4().hex}.parts"
    os.makedirs(work)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.taskcontext import TaskContext

        part = TaskContext.get().partitionId()
        own, n = f"{work}/{uuid.uuid4().hex}.tmp", 0
        gap = len(header_bytes(dt, False, (1 << 62,)))
        with open(own, "wb") as f:
            f.seek(gap)
            for batch in batches:
                f.write(np.ascontiguousarray(to_numpy(batch.column(1), dt)).tobytes())
                n += batch.num_rows
            f.seek(0)
            f.write(header_bytes(dt, False, (n,), gap))
        os.replace(own, f"{work}/part-{part:08d}.npy")
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    df.mapInArrow(write, "n long").agg(F.sum("n")).first()
    for left in [x for x in os.listdir(work) if x.endswith(".tmp")]:
        os.unlink(f"{work}/{left}")
    os.replace(work, folder)
    return folder
