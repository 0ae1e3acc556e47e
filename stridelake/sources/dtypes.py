"""Element types: typestr and field lists, their sizes, and the Spark types they are read as."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import types as T

from ..errors import Errors, NdError

BYTE_ORDERS = {"<": "little", ">": "big", "=": "native", "|": "not_relevant"}
_MAX = (1 << 64) - 1

# The Spark type that holds each numeric type code and size without loss.
NUMERIC = {
    "b1": T.BooleanType(), "?1": T.BooleanType(),
    "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(),
    "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "u8": T.DecimalType(20, 0),
    "f2": T.FloatType(), "f4": T.FloatType(), "f8": T.DoubleType(),
}
# The typestr that a Spark type is written as.
TYPESTR_OF = {"boolean": "|b1", "tinyint": "|i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8", "decimal(20,0)": "<u8"}


@dataclass(frozen=True)
class DType:
    """A field or the element itself. size is the typestr's number, item_size the bytes of one item with its shape."""

    name: str = ""
    order: str = "<"
    code: str = "f"
    size: int = 8
    shape: tuple[int, ...] = ()
    fields: tuple[DType, ...] = ()
    offset: int = 0
    item_size: int = 0

    @property
    def is_structured(self) -> bool:
        return bool(self.fields)

    @property
    def typestr(self) -> str:
        return f"{self.order}{self.code}{self.size}"

    def find_field(self, *names: str) -> DType | None:
        """The field at a path of names (first match at each level), or None."""
        here: DType | None = self
        for n in names:
            here = next((f for f in here.fields if f.name == n), None)
            if here is None:
                return None
        return here

    def add_field(self, child: DType) -> DType:
        return with_layout(replace(self, fields=(*self.fields, child)))

    def walk(self, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], DType]]:
        """Every field below this one with its path, depth first in order."""
        for f in self.fields:
            yield (*path, f.name), f
            yield from f.walk((*path, f.name))


def to_byte_order(c: str) -> str:
    return BYTE_ORDERS.get(c, "invalid")


def parse_typestr(text: str, name: str = "", shape: tuple[int, ...] = ()) -> DType:
    if len(text) < 3 or text[0] not in BYTE_ORDERS or not text[1].isalpha() and text[1] != "?":
        raise NdError(Errors.descr_invalid_string, repr(text))
    if not re.fullmatch(r"[0-9]+", text[2:]) or (int(text[2:]) == 0 and text[1] not in "SUV"):
        raise NdError(Errors.descr_invalid_data_size, repr(text))
    if text[1] == "O":
        raise NdError(Errors.descr_invalid_string, "objects are never read")
    return DType(name, text[0], text[1], int(text[2:]), shape)


def _field_shape(value: Any) -> tuple[int, ...]:
    if not isinstance(value, tuple):
        raise NdError(Errors.descr_list_invalid_shape, repr(value))
    if any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in value):
        raise NdError(Errors.descr_list_invalid_shape_value, repr(value))
    return value


def parse_descr(descr: Any, name: str = "", shape: tuple[int, ...] = ()) -> DType:
    """The element type of a header's descr: a typestr, or a list of (name, type[, shape])."""
    if isinstance(descr, str):
        return parse_typestr(descr, name, shape)
    if not isinstance(descr, list):
        raise NdError(Errors.descr_invalid_type if not name else Errors.descr_list_subtype_not_supported, repr(descr)[:80])
    if not descr:
        raise NdError(Errors.descr_list_empty)
    fields = []
    for item in descr:
        if not isinstance(item, tuple):
            raise NdError(Errors.descr_list_invalid_type, repr(item)[:80])
        if len(item) < 2:
            raise NdError(Errors.descr_list_incomplete_value, repr(item)[:80])
        if len(item) > 3:
            raise NdError(Errors.descr_list_invalid_value, repr(item)[:80])
        title = item[0]
        label = title[1] if isinstance(title, tuple) and len(title) == 2 else title
        if not isinstance(label, str):
            raise NdError(Errors.descr_list_invalid_value, repr(item)[:80])
        if not isinstance(item[1], (str, list)):
            raise NdError(Errors.descr_list_subtype_not_supported, repr(item)[:80])
        fields.append(parse_descr(item[1], label, _field_shape(item[2]) if len(item) == 3 else ()))
    return DType(name, "|", "V", 0, shape, tuple(fields))


def with_layout(dt: DType, offset: int = 0) -> DType:
    """dt with item sizes and the absolute offsets of all fields; NdError 604 beyond 64 bits."""
    if dt.fields:
        fields, at = [], offset
        for f in dt.fields:
            laid = with_layout(f, at)
            fields.append(laid)
            at += laid.item_size
        each = at - offset
    else:
        fields, each = [], dt.size * {"U": 4, "O": 8}.get(dt.code, 1)
    total = each * math.prod(dt.shape)
    if total > _MAX or offset + total > _MAX:
        raise NdError(Errors.size_overflow, dt.name)
    return replace(dt, fields=tuple(fields), offset=offset, item_size=total, size=each if dt.fields else dt.size)


def numpy_dtype(dt: DType) -> np.dtype:
    if dt.fields:
        names = [f.name if f.name else f"\0pad{k}" for k, f in enumerate(dt.fields)]
        made = np.dtype({"names": names, "formats": [numpy_dtype(f) for f in dt.fields], "offsets": [f.offset - dt.offset for f in dt.fields], "itemsize": dt.size})
    elif dt.code in "SUV":
        made = np.dtype(f"{dt.order if dt.code == 'U' else '|'}{dt.code}{dt.size}")
    else:
        try:
            made = np.dtype(f"{dt.order}{'b1' if dt.code in '?b' else dt.code + str(dt.size)}")
        except TypeError:
            made = np.dtype(f"V{dt.size}")
    return np.dtype((made, dt.shape)) if dt.shape else made


def spark_type(dt: DType) -> T.DataType:
    """The Spark type of a decoded item; nested lists for a field's shape."""
    if dt.fields:
        base: T.DataType = T.StructType([T.StructField(f.name, spark_type(f), True) for f in dt.fields if f.name])
    elif dt.code == "U":
        base = T.StringType()
    elif dt.code in "SV":
        base = T.BinaryType()
    elif dt.code == "c" and dt.size in (8, 16):
        part = T.FloatType() if dt.size == 8 else T.DoubleType()
        base = T.StructType([T.StructField("re", part), T.StructField("im", part)])
    else:
        base = NUMERIC.get(f"{dt.code}{dt.size}", T.BinaryType())
    for _ in dt.shape:
        base = T.ArrayType(base)
    return base


def dtype_of(spark: T.DataType, name: str = "", widths: dict[str, int] | None = None, path: tuple[str, ...] = ()) -> DType:
    """The element type that a Spark type is written as. widths: characters of string fields, bytes of binary ones."""
    path = (*path, name) if name else path
    if isinstance(spark, T.StructType):
        if [f.name for f in spark.fields] == ["re", "im"] and spark.fields[0].dataType == spark.fields[1].dataType and spark.fields[0].dataType.simpleString() in ("float", "double"):
            return DType(name, "<", "c", 8 if spark.fields[0].dataType.simpleString() == "float" else 16)
        return DType(name, "|", "V", 0, (), tuple(dtype_of(f.dataType, f.name, widths, path) for f in spark.fields))
    width = (widths or {}).get(".".join(path))
    if isinstance(spark, (T.StringType, T.BinaryType)):
        if width is None:
            raise NdError(Errors.descr_invalid_data_size, f"no width for {'.'.join(path) or 'value'}")
        return DType(name, "<", "U", width) if isinstance(spark, T.StringType) else DType(name, "|", "S", width)
    if spark.simpleString() not in TYPESTR_OF:
        raise NdError(Errors.descr_invalid_type, spark.simpleString())
    return parse_typestr(TYPESTR_OF[spark.simpleString()], name)


def serialize_shape(shape: tuple[int, ...]) -> str:
    return "(" + ", ".join(map(str, shape)) + ("," if len(shape) == 1 else "") + ")"


def serialize_descr(dt: DType) -> str:
    """The descr text of an element type, as a header has it."""
    if not dt.fields:
        return f"'{dt.typestr}'"
    parts = []
    for f in dt.fields:
        parts.append(f"('{f.name}', {serialize_descr(f)}" + (f", {serialize_shape(f.shape)}" if f.shape else "") + ")")
    return "[" + ", ".join(parts) + "]"


def field_rows(dt: DType) -> list[tuple[str, str, int, int, int]]:
    """(path, typestr or "struct", offset, item_size, end) of every field."""
    return [(".".join(path), "struct" if f.fields else f.typestr, f.offset, f.item_size, f.offset + f.item_size) for path, f in dt.walk()]
