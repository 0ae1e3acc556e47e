"""Headers of .npy files: reading, checking and writing."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from typing import BinaryIO

from ..errors import Errors, NdError, Warnings
from .dtypes import DType, parse_descr, serialize_descr, serialize_shape, with_layout
from .literal import parse_literal

# Fixed values of the file formats.
MAGIC = b"\x93NUMPY"
ZIP_MAGIC = b"PK\x03\x04"
ALIGN = 64


@dataclass(frozen=True)
class Header:
    version: tuple[int, int]
    text: str
    data_offset: int
    dtype: DType
    fortran_order: bool
    shape: tuple[int, ...] | None
    warnings: Warnings

    @property
    def size(self) -> int:
        """Items of the whole array."""
        n = math.prod(self.shape)
        if n * self.dtype.item_size > (1 << 64) - 1:
            raise NdError(Errors.size_overflow, str(self.shape))
        return n


def is_zip(head: bytes) -> bool:
    return head[:4] == ZIP_MAGIC


def read_header(stream: BinaryIO, payload_bytes: int | None = None, lenient: bool = False) -> Header:
    """Read and check a header; the stream stands at the payload afterwards.

    payload_bytes: bytes of the whole file or entry, if known, to compare with what the shape needs. lenient also
    takes version 3.0 and headers that don't end at a multiple of 64.
    """
    magic = stream.read(6)
    if is_zip(magic):
        raise NdError(Errors.wrong_filetype, "a zip archive")
    if magic != MAGIC:
        raise NdError(Errors.magic_string_invalid)
    version = tuple(stream.read(2))
    if version not in ((1, 0), (2, 0)) and not (lenient and version == (3, 0)):
        raise NdError(Errors.version_not_supported, str(version))
    width = 2 if version == (1, 0) else 4
    raw = stream.read(width)
    if len(raw) < width:
        raise NdError(Errors.file_truncated, "header length")
    length = int.from_bytes(raw, "little")
    offset = 8 + width + length
    if offset % ALIGN and not lenient:
        raise NdError(Errors.header_invalid_length, str(length))
    body = stream.read(length)
    if len(body) < length:
        raise NdError(Errors.file_truncated, "header")
    text = body.decode("utf-8" if version == (3, 0) else "latin-1")
    header = parse_header(text, version, offset)
    if payload_bytes is not None:
        header = check_payload(header, payload_bytes - offset)
    elif header.shape is None:
        raise NdError(Errors.data_size_mismatch, "no shape and no size to infer one from")
    return header


def parse_header(text: str, version: tuple[int, int], offset: int) -> Header:
    value = parse_literal(text)
    if value == {} and isinstance(value, dict):
        raise NdError(Errors.header_empty)
    if not isinstance(value, dict):
        raise NdError(Errors.header_invalid, "not a dict")
    warn = Warnings.none
    if "descr" not in value:
        raise NdError(Errors.descr_invalid, "missing")
    dtype = with_layout(parse_descr(value["descr"]))
    order = value.get("fortran_order", False)
    if "fortran_order" not in value:
        warn |= Warnings.missing_fortran_order
    if not isinstance(order, bool):
        raise NdError(Errors.fortran_order_invalid_value, repr(order))
    shape = value.get("shape")
    if "shape" not in value:
        warn |= Warnings.missing_shape
    else:
        if not isinstance(shape, tuple):
            raise NdError(Errors.shape_invalid_value, repr(shape))
        if any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in shape):
            raise NdError(Errors.shape_invalid_shape_value, repr(shape))
    return Header(version, text, offset, dtype, order, shape, warn)


def check_payload(header: Header, data_bytes: int) -> Header:
    """The header, with a one-dimensional shape if it has none; NdError 404 or 405 if the payload doesn't fit."""
    item = header.dtype.item_size
    if item == 0:
        if header.shape is None or header.size:
            raise NdError(Errors.item_size_mismatch, "items of no size")
        return header
    if data_bytes % item:
        raise NdError(Errors.data_size_mismatch, f"{data_bytes} bytes, items of {item}")
    if header.shape is None:
        return Header(header.version, header.text, header.data_offset, header.dtype, header.fortran_order, (data_bytes // item,), header.warnings)
    if header.size * item != data_bytes:
        raise NdError(Errors.data_size_mismatch, f"{data_bytes} bytes, shape {header.shape} of {item}")
    return header


def header_text(dtype: DType, fortran_order: bool, shape: tuple[int, ...]) -> str:
    return f"{{'descr': {serialize_descr(dtype)}, 'fortran_order': {fortran_order}, 'shape': {serialize_shape(shape)}, }}"


def header_bytes(dtype: DType, fortran_order: bool, shape: tuple[int, ...], least: int = 0) -> bytes:
    """A version 2.0 header whose end is a multiple of 64 and at least ``least``."""
    text = header_text(dtype, fortran_order, shape).encode("latin-1")
    length = -(-max(12 + len(text) + 1, least) // ALIGN) * ALIGN - 12
    return MAGIC + b"\x02\x00" + struct.pack("<I", length) + text.ljust(length - 1) + b"\n"
