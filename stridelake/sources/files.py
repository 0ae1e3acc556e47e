"""Files by path or URI, on the driver and on executors alike."""

from __future__ import annotations

import io
import zipfile
from typing import BinaryIO

import pyarrow.fs as pafs

from ..errors import Errors, NdError
from .header import ZIP_MAGIC


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def expand(path: str, suffix: str) -> list[str]:
    """The files of a path: itself, or those with the suffix in a folder, in order of their names."""
    fs, at = locate(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.Directory:
        prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
        found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=False)) if f.is_file and f.path.endswith(suffix))
        return [prefix + f for f in found]
    if info.type == pafs.FileType.NotFound:
        raise NdError(Errors.file_not_found, path)
    return [path]


def open_file(path: str) -> tuple[BinaryIO, int]:
    """An open file and its size."""
    fs, at = locate(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise NdError(Errors.file_not_found, path)
    try:
        return fs.open_input_file(at), info.size
    except OSError as e:
        raise NdError(Errors.file_open_failed, str(e)) from None


def open_entry(path: str, entry: str) -> tuple[BinaryIO, int]:
    """A stream over an entry of a zip archive and its size."""
    archive = open_archive(path)
    try:
        info = archive.getinfo(entry)
    except KeyError:
        raise NdError(Errors.file_not_found, f"{path}:{entry}") from None
    return io.BufferedReader(archive.open(info), 1 << 20), info.file_size


def open_archive(path: str) -> zipfile.ZipFile:
    stream, _ = open_file(path)
    if stream.read(4) != ZIP_MAGIC:
        raise NdError(Errors.wrong_filetype, f"{path} is no zip archive")
    stream.seek(0)
    try:
        return zipfile.ZipFile(stream)
    except zipfile.BadZipFile as e:
        raise NdError(Errors.unsupported_file_format, str(e)) from None


def array_name(entry: str) -> str:
    """An entry's name without its last extension."""
    stem, dot, _ = entry.rpartition(".")
    return stem if dot else entry
