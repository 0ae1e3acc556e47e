"""Byte order and bit fields as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def bswap(value: Column, width: int) -> Column:
    """Bytes of an integer of 1, 2, 4 or 8 bytes in reverse, as the signed integer of that width."""
    if width == 1:
        return value.cast("tinyint")
    x = value.cast("long")
    out = F.lit(0).cast("long")
    for k in range(width):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255).cast("long")), 8 * (width - 1 - k)))
    bits = 8 * width
    if width < 8:  # the top bit is the sign
        out = F.shiftright(F.shiftleft(out, 64 - bits), 64 - bits)
    return out.cast({2: "smallint", 4: "int", 8: "long"}[width])


def bswap_binary(value: Column) -> Column:
    return F.reverse(value)


def _swapped(kind: str):
    @F.arrow_udf("float" if kind == "f4" else "double")
    def swap(x: pa.Array) -> pa.Array:
        values = x.fill_null(0.0).to_numpy(zero_copy_only=False).astype(kind)
        return pa.array(values.byteswap(), mask=x.is_null().to_numpy(zero_copy_only=False))  # a NaN stays a NaN

    return swap


def bswap_float(value: Column) -> Column:
    """Bytes of a float in reverse. Spark SQL has no view of a float's bits, hence Arrow batches."""
    return _swapped("f4")(value)


def bswap_double(value: Column) -> Column:
    return _swapped("f8")(value)


def bswap_complex(value: Column, width: int = 8) -> Column:
    """Both parts of struct<re, im> swapped on their own; width: bytes of a part."""
    swap = bswap_double if width == 8 else bswap_float
    return F.struct(swap(value["re"]).alias("re"), swap(value["im"]).alias("im"))


def _col(x: Column | int) -> Column:
    return x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")


def flag_is_set(value: Column, flag: Column | int) -> Column:
    return value.cast("long").bitwiseAND(_col(flag)) == _col(flag)


def set_flag(value: Column, flag: Column | int) -> Column:
    return value.cast("long").bitwiseOR(_col(flag))


def clear_flag(value: Column, flag: Column | int) -> Column:
    return value.cast("long").bitwiseAND(F.bitwise_not(_col(flag)))


def toggle_flag(value: Column, flag: Column | int) -> Column:
    return value.cast("long").bitwiseXOR(_col(flag))


def bitmask(offset: int, length: int) -> int:
    """``length`` ones from bit ``offset`` on, as a signed 64-bit number; all 64 bits are possible."""
    mask = (((1 << length) - 1) << offset) & ((1 << 64) - 1)
    return mask - (1 << 64) if mask >> 63 else mask


def set_bits(value: Column, offset: int, length: int, bits: Column | int) -> Column:
    """value with the field replaced by the low bits of ``bits``."""
    mask = bitmask(offset, length)
    return clear_flag(value, mask).bitwiseOR(F.shiftleft(_col(bits), offset).bitwiseAND(F.lit(mask).cast("long")))


def get_bits(value: Column, offset: int, length: int) -> Column:
    return F.shiftrightunsigned(value.cast("long"), offset).bitwiseAND(F.lit(bitmask(0, length)).cast("long"))


def toggle_bits(value: Column, offset: int, length: int) -> Column:
    return toggle_flag(value, bitmask(offset, length))


def bit_is_set(value: Column, n: int) -> Column:
    return F.getbit(value.cast("long"), F.lit(n)) == 1


def set_bit(value: Column, n: int) -> Column:
    return set_flag(value, bitmask(n, 1))


def clear_bit(value: Column, n: int) -> Column:
    return clear_flag(value, bitmask(n, 1))


def toggle_bit(value: Column, n: int) -> Column:
    return toggle_flag(value, bitmask(n, 1))
