"""Index algebra as column expressions. Shapes and strides count items; axes count from 0."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Errors, NdError, report

_MAX = (1 << 64) - 1


def strides(shape: Sequence[int], fortran_order: bool = False) -> tuple[int, ...]:
    """Items between neighbours along each axis."""
    n = len(shape)
    return tuple(math.prod(shape[:k]) if fortran_order else math.prod(shape[k + 1 :]) for k in range(n))


def stride_row_major(shape: Column, axis: int) -> Column:
    """Product of the lengths behind an axis, for shapes that differ by row."""
    return F.aggregate(F.slice(shape, axis + 2, F.greatest(F.size(shape) - axis - 1, F.lit(0))), F.lit(1).cast("long"), lambda a, x: a * x.cast("long"))


def stride_col_major(shape: Column, axis: int) -> Column:
    """Product of the lengths before an axis."""
    return F.aggregate(F.slice(shape, 1, axis), F.lit(1).cast("long"), lambda a, x: a * x.cast("long"))


def strides_of(shape: Column, fortran_order: bool = False) -> Column:
    """All strides of an array column of lengths."""
    before = lambda k: F.aggregate(F.slice(shape, F.lit(1), k), F.lit(1).cast("long"), lambda a, x: a * x.cast("long"))
    behind = lambda k: F.aggregate(F.slice(shape, k + 2, F.size(shape) - k - 1), F.lit(1).cast("long"), lambda a, x: a * x.cast("long"))
    axes = F.when(F.size(shape) > 0, F.sequence(F.lit(0), F.size(shape) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(axes, before if fortran_order else behind)


def unravel(index: Column, shape: Sequence[int], fortran_order: bool = False) -> list[Column]:
    """The index along each axis of a flat index."""
    out = []
    for k, (step, n) in enumerate(zip(strides(shape, fortran_order), shape)):
        at = index.cast("long") if step == 1 else F.call_function("div", index.cast("long"), F.lit(step).cast("long"))
        outer = k == 0 and not fortran_order or k == len(shape) - 1 and fortran_order
        out.append(at if outer else at % F.lit(n).cast("long"))
    return out


def unravel_strided(offset: Column, steps: Sequence[int], fortran_order: bool = False) -> list[Column]:
    """The index along each axis of an offset, from strides: the largest stride is divided out first."""
    out: list[Column | None] = [None] * len(steps)
    rest = offset.cast("long")
    order = range(len(steps) - 1, -1, -1) if fortran_order else range(len(steps))
    for k in order:
        out[k] = F.call_function("div", rest, F.lit(steps[k]).cast("long"))
        rest = rest % F.lit(steps[k]).cast("long")
    return out


def ravel(indices: Sequence[Column | int], shape: Sequence[int], fortran_order: bool = False) -> Column:
    """The flat index of one index per axis; NdError 603 if their number differs from the axes'."""
    if len(indices) != len(shape):
        raise NdError(Errors.index_shape_mismatch, f"{len(indices)} indices, {len(shape)} axes")
    total = F.lit(0).cast("long")
    for i, step in zip(indices, strides(shape, fortran_order)):
        total = total + (i if isinstance(i, Column) else F.lit(i)).cast("long") * F.lit(step).cast("long")
    return total


def ravel_array(indices: Column, steps: Column) -> Column:
    """The flat index of an array column of indices, with an array column of strides."""
    return F.aggregate(F.zip_with(indices, steps, lambda a, b: a.cast("long") * b.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def normalize_index(index: Column, length: Column | int, on_error: str = "raise") -> Column:
    """An index that may count from the end once; out of range: error 602 or null."""
    n = (length if isinstance(length, Column) else F.lit(length)).cast("long")
    i = index.cast("long")
    at = F.when(i < 0, i + n).otherwise(i)
    return report((at >= 0) & (at < n), Errors.index_out_of_bounds, at, on_error)


def normalized(indices: Sequence[int], shape: Sequence[int]) -> tuple[int, ...]:
    """normalize_index for numbers."""
    if len(indices) != len(shape):
        raise NdError(Errors.index_shape_mismatch, f"{len(indices)} indices, {len(shape)} axes")
    out = tuple(i + n if i < 0 else i for i, n in zip(indices, shape))
    if any(not 0 <= i < n for i, n in zip(out, shape)):
        raise NdError(Errors.index_out_of_bounds, f"{tuple(indices)} in {tuple(shape)}")
    return out


def checked_size(shape: Sequence[int]) -> int:
    """Items of a shape; NdError 604 if they don't fit into 64 bits."""
    n = math.prod(shape)
    if n > _MAX:
        raise NdError(Errors.size_overflow, str(tuple(shape)))
    return n


def size_of(shape: Column) -> Column:
    """Items of an array column of lengths; null where they don't fit into a long."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: F.try_multiply(a, x.cast("long")))
