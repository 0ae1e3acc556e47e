"""Operator 9: zstandard WARC archives with a dictionary in the leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, materialize, new_path

# Fixed values of the .warc.zst and WARC 1.1 formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
ZSTD_DICTIONARY_MAGIC = 0xEC30A437
ZSTD_FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ID = re.compile(r"<urn:page:(-?\d+|null)>\Z")


class WarcError(ValueError):
    """An archive breaks the format."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    found = _ID.match(urn)
    if not found:
        raise WarcError(f"not the id of a page: {urn!r}")
    return None if found[1] == "null" else int(found[1])


def build_record(page_id: int | None, url: str | None, payload: bytes | None, payload_bytes: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or (payload None) a revisit record, which keeps the HTTP headers with the full length."""
    is_revisit = payload is None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode() + (payload or b"")
    head = [f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"\r\n".join([VERSION, "\r\n".join(head).encode("utf-8", "surrogatepass"), b"", block, b"", b""])


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises WarcError unless headers, lengths and digest are those of exactly one record."""
    end = data.find(b"\r\n\r\n")
    lines = data[:end].split(b"\r\n") if end >= 0 else [b""]
    if lines[0] != VERSION:
        raise WarcError("no WARC version line")
    head = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"header without a colon: {line[:60]!r}")
        head[name.decode().lower()] = value.strip().decode("utf-8", "surrogatepass")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in head:
            raise WarcError(f"no {need}")
    if not head["content-length"].isdigit():
        raise WarcError("Content-Length is not a number")
    stop = end + 4 + int(head["content-length"])
    if data[stop:] != b"\r\n\r\n":
        raise WarcError("Content-Length differs from the block's length")
    block = data[end + 4 : stop]
    http_head, blank, payload = block.partition(b"\r\n\r\n")
    http_length = re.search(rb"\r\ncontent-length: *(\d+)(?:\r|\Z)", http_head, re.I)
    if not blank or not http_length:
        raise WarcError("no HTTP headers with a length")
    kind, digest, length = head["warc-type"], head.get("warc-payload-digest", ""), int(http_length[1])
    if kind == "response":
        if len(payload) != length:
            raise WarcError("the payload's length differs from its HTTP header")
        if digest != f"sha1:{base32_sha1(payload)}":
            raise WarcError("the payload's digest differs")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in head:
            raise WarcError("a revisit with a payload or without WARC-Refers-To")
    else:
        raise WarcError(f"unknown type {kind!r}")
    return {
        "page_id": _page_id(head["warc-record-id"]),
        "url": head.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": digest.removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": _page_id(head["warc-refers-to"]) if kind == "revisit" else None,
    }


def train_dictionary(samples: list[bytes], size: int) -> bytes | None:
    """A zstandard dictionary, or None where there is too little text for one."""
    size = min(size, sum(map(len, samples)) // 10)
    if len(samples) < 16 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_DICTIONARY, len(packed)) + packed


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an open archive, one for each frame, with one chunk and one record in memory."""
    head = stream.read(4)
    dictionary = None
    if len(head) == 4 and struct.unpack("<I", head)[0] == SKIPPABLE_DICTIONARY:
        (length,) = struct.unpack("<I", stream.read(4))
        data = stream.read(length)
        if len(data) < max(4, length):
            raise WarcError("the dictionary is cut off")
        if struct.unpack("<I", data[:4])[0] == ZSTD_FRAME_MAGIC:
            data = zstandard.ZstdDecompressor().decompress(data)
        if struct.unpack("<I", data[:4])[0] != ZSTD_DICTIONARY_MAGIC:
            raise WarcError("the leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT)
        head = b""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    rest = head + stream.read(chunk)
    while rest:
        while len(rest) < 18 and (more := stream.read(chunk)):  # the longest frame header
            rest += more
        if struct.unpack("<I", rest[:4].ljust(4, b"\0"))[0] != ZSTD_FRAME_MAGIC:
            raise WarcError("no zstandard frame where a record should start")
        if dictionary and zstandard.get_frame_parameters(rest).dict_id != dictionary.dict_id():
            raise WarcError("a frame that needs another dictionary")
        frame, out = decoder.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(chunk)):
                raise WarcError("the last frame is cut off")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(out)
        rest = rest or stream.read(chunk)


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    min_revisit_bytes: int = 0,
    archive_bytes: int = 32 << 20,
    level: int = 3,
    dictionary_bytes: int = 64 << 10,
    sample_rows: int = 400,
    sample_row_bytes: int = 64 << 10,
    date: str = "1970-01-01T00:00:00Z",
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) to .warc.zst files; returns their manifest.

    folder: a URI that all executors reach (default: a new one in the shared folder). Of the records with equal
    payloads of min_revisit_bytes bytes at least, the one with the largest page_id is the response and the others
    revisit it. One aggregate over digests, no html in it, gives the responses of payloads that occur more than once;
    that table is written, and sent to all tasks if it measures broadcast_bytes at most, so html is not shuffled;
    else pages are joined with it by digest, both sides shuffled for that join alone, so that Spark can split a
    payload with very many copies. The dictionary is trained once on at most sample_rows whole pages of at
    most sample_row_bytes, drawn at random, and is at most dictionary_bytes long. Each task rolls over to a new file
    at archive_bytes. Files of failed attempts are not in the manifest, which is written only from finished tasks.

    Null html: an empty payload. Null url: no target. Null page_id: below all others. Rows that repeat the largest
    page_id of their payload are each written as a response. Empty table: no archive.
    """
    spark = pages.sparkSession
    importable(spark)
    folder = folder or new_path(spark, "warc")
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    n = pages.count()
    sample = p.filter(F.col("payload_bytes").between(1, sample_row_bytes)).sample(min(1.0, 1.3 * sample_rows / max(n, 1)), seed=42)
    dictionary = train_dictionary([bytes(r[0]) for r in sample.select("payload").limit(sample_rows).collect()], dictionary_bytes)

    same = p.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    same = materialize(same.filter((F.col("n") > 1) & (F.col("payload_bytes") >= min_revisit_bytes)).drop("n"), "warc-same")
    # 64 bytes for a digest, a length and an id; html stays where it is read unless there are too many of them.
    known = F.broadcast(same) if same.count() * 64 <= broadcast_bytes else same.hint("merge")
    p = p.join(known, ["sha1", "payload_bytes"], "left")
    is_revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    rows = p.select("page_id", "url", F.when(is_revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"), "sha1", "payload_bytes", "response_id")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=level, dict_data=given) if given else zstandard.ZstdCompressor(level=level)
        if given:
            given.precompute_compress(level=level)
        made, out, path, size, count = [], None, "", 0, 0

        def close():
            out.close()
            made.append((path, count, size))

        for batch in batches:
            for page_id, url, payload, sha1, length, response_id in zip(*(c.to_pylist() for c in batch.columns)):
                if out is not None and size >= archive_bytes:
                    close()
                    out = None
                if out is None:
                    fs.create_dir(root, recursive=True)
                    path, size, count = f"{root}/{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = fs.open_output_stream(path)
                    if dictionary:
                        frame = dictionary_frame(dictionary)
                        out.write(frame)
                        size += len(frame)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                frame = encoder.compress(build_record(page_id, url, payload, length, digest, response_id, date))
                out.write(frame)
                size += len(frame)
                count += 1
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["path", "records", "bytes"])

    manifest = materialize(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")
    manifest.warc_folder = folder
    return manifest


_READ = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
_READ_DDL = {"page_id": "long", "url": "string", "payload": "binary", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"}


def read_archives(manifest: DataFrame, folder: str, columns: tuple[str, ...] = tuple(_READ), batch_bytes: int = 16 << 20) -> DataFrame:
    """A row per record of the archives that the manifest lists, which are read as streams, a task for each few.

    Every frame is decoded with the dictionary of its file and must hold one valid record (WarcError if not). A
    count of records that differs from the manifest's also fails.
    """
    importable(manifest.sparkSession)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _READ[c]) for c in columns], names=list(columns))

        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, n = [], 0, 0
                with fs.open_input_stream(path) as stream:
                    for data in read_archive(stream):
                        rows.append(parse_record(data))
                        n += 1
                        held += len(data)
                        if held >= batch_bytes or len(rows) >= 4096:
                            yield pack(rows)
                            rows, held = [], 0
                if n != records:
                    raise WarcError(f"{path} holds {n} records, not {records}")
                if rows:
                    yield pack(rows)

    files = max(1, manifest.count())
    spread = manifest.select("path", "records").coalesce(1).repartition(files)
    return spread.mapInArrow(read, ", ".join(f"{c} {_READ_DDL[c]}" for c in columns))
