"""Operator 1: shortest-pack-first packing of token sequences over the length histogram."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import importable, materialize

#: Texts whose characters all lie here are cut at white space before they are looked up; others go to the tokenizer whole.
_PLAIN = re.compile("[^\\t\\n\\r -~¡-ɏͰ-ͳΆ-ϿЀ-ҁҊ-ԯ]")
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_UNEVEN = re.compile(r"\s\s|[\t\r]")


class _Ids(dict):
    """Chunk -> its ids as little-endian uint32; keeps chunks of at most 256 characters, and forgets all when it has
    grown to ``limit`` of them."""

    def __init__(self, encode, prefix: str, limit: int):
        self.encode, self.prefix, self.limit = encode, prefix, limit

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(self.prefix + chunk)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 256:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = out
        return out


class Encoder:
    """Ids of a byte-level BPE vocabulary, as ``tokenizers`` gives them without special tokens.

    The vocabulary's pattern never joins characters across the start of a run of white space but for one leading
    space, so chunks of that kind have ids of their own, which are kept. New chunks go to ``tiktoken``, which has
    the same ranks; texts with other characters or with a special token's string go to ``tokenizers`` whole.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str, pattern: str, limit: int = 300_000):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.first, self.later, self.line = _Ids(encode, "", limit), _Ids(encode, " ", limit), struct.pack("<I", *encode("\n"))
        self.file, self.whole = tokenizer_file, None

    def __call__(self, text: str) -> bytes:
        if "<|" in text or _PLAIN.search(text):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.file)
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        first, later = self.first.__getitem__, self.later.__getitem__
        if _UNEVEN.search(text):
            return b"".join(map(first, _CHUNK.findall(text)))
        parts = []
        for line in text.split("\n"):
            words = line.split(" ")
            parts.append(self.line)
            if words[0]:
                parts.append(first(words[0]))
            parts.extend(map(later, words[1:]))
        return b"".join(parts[1:])


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that fit into size, with their counts; each length is used as often as the histogram says.

    Lengths are placed longest first. All sequences of a length go to the packs that are shortest so far, taking
    whole groups of equal packs or splitting one, and open new packs when none has room. Work and result depend on
    the number of different lengths, not of sequences.
    """
    open_packs: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, count]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = size
        while left:
            while room >= length and not open_packs.get(room):
                room -= 1
            if room < length:
                open_packs[size - length].append([(length,), left])
                break
            pattern, count = open_packs[room].pop()
            used = min(count, left)
            if count > used:
                open_packs[room].append([pattern, count - used])
            open_packs[room - length].append([(*pattern, length), used])
            left -= used
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in open_packs.values():
        for pattern, count in packs:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from rank, to rank, sequence_id of from rank, offset) for each place of each pattern."""
    rank: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.append((length, rank[length], rank[length] + count, base, offset))
            rank[length] += count
            offset += length
        base += count
    return out


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset. pieces: a table with length (1 to size), part and local_rank.

    local_rank counts the pieces of equal length in a part from 0, so ranks over all parts are local ranks plus sums
    over the earlier parts: one row for each part and length is summed, and the pieces themselves are not sorted.
    The histogram (at most size rows) is all that the driver sees; the table of places has a size that depends on
    the number of lengths alone, and is joined by length and range of ranks.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(shortest_pack_first(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("rank0"))
    places = spark.createDataFrame(slots, "length long, lo long, hi long, sequence0 long, offset long")
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("rank0") + F.col("local_rank"))
    placed = ranked.join(F.broadcast(places), "length").filter("rank >= lo AND rank < hi")
    return placed.withColumn("sequence_id", F.expr("sequence0 + rank - lo")).drop("part", "local_rank", "rank0", "rank", "lo", "hi", "sequence0")


def token_pieces(
    docs: DataFrame, tokenizer_file: str, ranks_file: str, pattern: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of at most size tokens: doc_id, start, length, ids_crc32, doc_tokens, part, local_rank (and ids).

    A document is its ids and then end_id; it is cut after every size tokens. Null text counts as empty: one piece
    with end_id alone. Documents are encoded one at a time; the rows have no text and, unless with_ids, no ids.
    """
    importable(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())]
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_rank long" + ", ids binary" * with_ids
    names = [n for n, _ in fields] + ["ids"] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = Encoder(tokenizer_file, ranks_file, pattern), struct.pack("<I", end_id), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    length = len(piece) // 4
                    rows.append((doc_id, start, length, zlib.crc32(piece), total, part, seen[length]) + ((piece,) if with_ids else ()))
                    seen[length] += 1
            made = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, [t for _, t in fields] + [pa.binary()] * with_ids)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, ddl)


def pack_documents(docs: DataFrame, tokenizer_file: str, ranks_file: str, pattern: str, size: int = 1024, with_ids: bool = False, **kw) -> DataFrame:
    """Pieces of docs with the sequence and the offset at which each stands; see token_pieces and pack.

    Sequences are filled without gaps from 0. Rows that repeat a doc_id are packed each on their own. No documents: no rows.
    """
    return pack(materialize(token_pieces(docs, tokenizer_file, ranks_file, pattern, size, with_ids=with_ids, **kw), "pieces"), size)
