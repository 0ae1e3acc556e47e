"""Items of an array as Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .dtypes import DType


def _native(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype(x.dtype.newbyteorder("="), copy=False))


def _leaf(x: np.ndarray, dt: DType) -> pa.Array:
    """A column of flat values; widened where Spark has no unsigned or half type."""
    code, size = dt.code, dt.size
    if code == "U":
        return pa.array(x.tolist(), pa.string())
    if code == "S":
        return pa.array(x.tolist(), pa.binary())
    if code == "c" and size in (8, 16):
        x = _native(x)
        part = pa.float32() if size == 8 else pa.float64()
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x.real), part), pa.array(np.ascontiguousarray(x.imag), part)], names=["re", "im"])
    if x.dtype.kind == "V" or (code, size) in (("f", 16), ("c", 32)):
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
        return pa.array([r.tobytes() for r in raw], pa.binary())
    x = _native(x)
    if code == "u":
        if size == 8:
            return pa.array(x.astype(object), pa.decimal128(20, 0)) if len(x) and int(x.max()) > (1 << 63) - 1 else pa.array(x.astype(np.int64)).cast(pa.decimal128(20, 0))
        return pa.array(x.astype({1: np.int16, 2: np.int32, 4: np.int64}[size]))
    if code == "f" and size == 2:
        return pa.array(x.astype(np.float32))
    return pa.array(x)


def to_arrow(x: np.ndarray, dt: DType) -> pa.Array:
    """x (one item per row, with the field's own shape behind) as a column of spark_type(dt)."""
    if dt.shape:
        n = len(x)
        flat = x.reshape(n * int(np.prod(dt.shape)), *x.shape[1 + len(dt.shape) :])
        column = to_arrow(flat, DType(dt.name, dt.order, dt.code, dt.size, (), dt.fields, dt.offset, dt.item_size))
        for axis in reversed(range(len(dt.shape))):
            rows = n * int(np.prod(dt.shape[:axis]))
            column = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dt.shape[axis], pa.int32()), column)
        return column
    if dt.fields:
        named = [(k, f) for k, f in enumerate(dt.fields) if f.name]
        return pa.StructArray.from_arrays([to_arrow(x[f.name], f) for _, f in named], names=[f.name for _, f in named])
    return _leaf(x, dt)
