"""Error codes, warnings and results of reading and writing arrays."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum, IntFlag

from pyspark.sql import Column
from pyspark.sql import functions as F


# Names and numbers that callers test for.
class Warnings(IntFlag):
    none = 0
    missing_descr = 1
    missing_fortran_order = 2
    missing_shape = 4


class Errors(IntEnum):
    none = 0
    wrong_filetype = 101
    file_not_found = 102
    file_exists = 103
    file_open_failed = 104
    file_truncated = 105
    file_write_failed = 106
    file_read_failed = 107
    file_close = 108
    unsupported_file_format = 109
    duplicate_array_name = 110
    magic_string_invalid = 201
    version_not_supported = 202
    header_invalid_length = 203
    header_truncated = 204
    header_parsing_error = 205
    header_invalid = 206
    header_empty = 207
    descr_invalid = 301
    descr_invalid_type = 302
    descr_invalid_string = 303
    descr_invalid_data_size = 304
    descr_list_empty = 305
    descr_list_invalid_type = 306
    descr_list_incomplete_value = 307
    descr_list_invalid_value = 308
    descr_list_invalid_shape = 309
    descr_list_invalid_shape_value = 310
    descr_list_subtype_not_supported = 311
    fortran_order_invalid_value = 401
    shape_invalid_value = 402
    shape_invalid_shape_value = 403
    item_size_mismatch = 404
    data_size_mismatch = 405
    unavailable = 406
    mmap_failed = 501
    seek_failed = 502
    reader_not_open = 503
    invalid_item_offset = 504
    invalid_data_pointer = 505
    munmap_failed = 506
    invalid_value = 601
    index_out_of_bounds = 602
    index_shape_mismatch = 603
    size_overflow = 604


class NdError(Exception):
    """An error with its code; ``code`` is a member of Errors."""

    def __init__(self, code: int, message: str = ""):
        self.code = Errors(code)
        super().__init__(f"{self.code.name} ({int(self.code)})" + (f": {message}" if message else ""))

    def __reduce__(self):
        return _raised, (int(self.code), self.args[0])


def _raised(code: int, text: str) -> NdError:
    e = NdError(code)
    e.args = (text,)
    return e


@dataclass(frozen=True)
class Result:
    """Warnings and an error; ``|`` joins the warnings and keeps the first error."""

    warn: Warnings = Warnings.none
    err: Errors = Errors.none

    @property
    def is_ok(self) -> bool:
        return self.err == Errors.none

    @property
    def has_error(self) -> bool:
        return not self.is_ok

    @property
    def has_warning(self) -> bool:
        return bool(self.warn)

    def __or__(self, other: Result) -> Result:
        return Result(self.warn | other.warn, self.err if self.has_error else other.err)

    def __str__(self) -> str:
        warns = " | ".join(w.name for w in Warnings if w and w in self.warn) or "none"
        return f"{warns}, {self.err.name}"

    def check(self) -> Result:
        """This result, or NdError if it holds an error."""
        if self.has_error:
            raise NdError(self.err)
        return self


def report(condition: Column, code: Errors, value: Column, on_error: str = "raise") -> Column:
    """value where condition holds; elsewhere an error with the code's name ("raise") or null ("null")."""
    bad = F.raise_error(F.lit(f"{code.name} ({int(code)})")) if on_error == "raise" else F.lit(None)
    return F.when(condition, value).otherwise(bad)
