"""Code points, byte strings and formatting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Errors, report
from .checked import code_in


def to_ucs4(text: Column) -> Column:
    """Code points of a string."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c))


def ucs4_fits(text: Column, size: int, on_error: str = "raise") -> Column:
    """The string, if it has at most size code points."""
    return report(F.length(text) <= size, Errors.invalid_value, text, on_error)


def ucs4_bytesize(text: Column, size: int | None = None) -> Column:
    """Bytes of the string as 4-byte code points, or of a fixed string of size code points."""
    return F.lit(4 * size).cast("long") if size is not None else (F.length(text) * 4).cast("long")


def ucs4_bytes(text: Column, big_endian: bool = False) -> Column:
    """The string as 4-byte code points."""
    if big_endian:
        return F.encode(text, "UTF-32")
    # The bytes of the reversed string, backwards: as characters, one for each byte.
    return _bytes(F.reverse(_chars(F.encode(F.reverse(text), "UTF-32"))))


def from_ucs4_bytes(raw: Column, big_endian: bool = False) -> Column:
    """The string of 4-byte code points, up to the first NUL; code points beyond U+10FFFF and a last part of under 4 bytes are left out, surrogates an error."""
    kept = F.regexp_extract(_chars(raw), r"(?s)^(?:(?!\x00{4}).{4})*+", 0)
    points = kept if big_endian else F.reverse(kept)
    # Of surrogates only the last two bytes stay, which no decoder takes; else it would join pairs and make others "?".
    valid = F.regexp_replace(points, r"(?s)\x00\x00([\xD8-\xDF].)|(\x00[\x00-\x10]..)|....", "$1$2")
    # The decoder drops one byte order mark, so that a text's own stays.
    text = F.decode(_bytes(F.concat(F.lit("\x00\x00\xfe\xff"), valid)), "UTF-32")
    return text if big_endian else F.reverse(text)


def _chars(raw: Column) -> Column:
    """A character for each byte."""
    return F.decode(raw, "ISO-8859-1")


def _bytes(chars: Column) -> Column:
    return F.encode(chars, "ISO-8859-1")


def to_utf8(text: Column, size: int | None = None, on_error: str = "raise") -> Column:
    """UTF-8 of a string; with size padded with NULs to it, and an error (or null) if there are more bytes."""
    raw = F.encode(text, "UTF-8")
    if size is None:
        return raw
    return report(F.octet_length(raw) <= size, Errors.invalid_value, F.rpad(raw, size, F.unhex(F.lit("00"))), on_error)


def utf8_to_string(raw: Column) -> Column:
    """The string of UTF-8 bytes, trailing NULs kept."""
    return F.decode(raw, "UTF-8")


def is_valid_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw.cast("string"))


def join_format(items: Column, sep: str = ", ", begin: str = "[", end: str = "]") -> Column:
    """Items of an array as text between begin and end."""
    return F.concat(F.lit(begin), F.array_join(items.cast("array<string>"), sep), F.lit(end))


def shape_text(shape: Column) -> Column:
    """A shape as a header has it: "(5,)" for one axis, "()" for none."""
    return F.concat(F.lit("("), F.array_join(shape.cast("array<string>"), ", "), F.when(F.size(shape) == 1, ",").otherwise(""), F.lit(")"))


def order_text(fortran_order: Column) -> Column:
    return F.concat(F.lit("'fortran_order': "), F.when(fortran_order, "True").otherwise("False"))


def typestr_text(order: Column, code: Column, size: Column) -> Column:
    return F.concat(order, code, size.cast("string"))


def byte_order_name(c: Column) -> Column:
    return code_in(c, {"<": "little", ">": "big", "=": "native", "|": "not_relevant"}, "invalid")


def hexdump_lines(raw: Column) -> Column:
    """Lines of a hex dump: offset, 16 bytes, and their printable characters."""
    n = F.octet_length(raw)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(16))).otherwise(F.array().cast("array<int>"))

    def line(at: Column) -> Column:
        part = F.substring(raw, at + 1, F.lit(16))
        digits = F.rpad(F.lower(F.regexp_replace(F.hex(part), "(..)", "$1 ")), 48, " ")
        shown = F.regexp_replace(F.decode(part, "ISO-8859-1"), "[^\\x20-\\x7E]", ".")
        return F.concat(F.lower(F.lpad(F.hex(at), 8, "0")), F.lit(": "), digits, F.lit(" | "), shown)

    return F.transform(starts, line)


def tensor_text(items: Column, shape: tuple[int, ...], indent: str = "") -> Column:
    """Nested brackets for an array column in row-major order, items two characters wide at least."""
    if not shape:
        return F.lit("[]")

    def level(dim: int, base: Column) -> Column:
        if dim == len(shape) - 1:
            cells = F.transform(F.sequence(F.lit(1), F.lit(shape[dim])), lambda k: _wide(F.element_at(items, (base + k).cast("int")).cast("string")))
            return F.concat(F.lit("["), F.array_join(cells, ", "), F.lit("]"))
        step = 1
        for n in shape[dim + 1 :]:
            step *= n
        parts = F.transform(F.sequence(F.lit(0), F.lit(shape[dim] - 1)), lambda k: level(dim + 1, base + k * step))
        return F.concat(F.lit((indent if dim == 0 else "") + "["), F.array_join(parts, ",\n" + indent + " " * (dim + 1)), F.lit("]"))

    return level(0, F.lit(0))


def _wide(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.lpad(text, 2, " ")).otherwise(text)
