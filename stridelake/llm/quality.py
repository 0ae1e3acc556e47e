"""Operator 6: quality rules with zstandard compression bands."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_input, discard, held_out, importable, materialize

SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES = [c.encode() for c in SYMBOLS]
_SPACES = [bytes([b]) for b in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)]
_WORD = re.compile(rb"[^\x20\x09-\x0D]")


@dataclass(frozen=True)
class Bands:
    """Limits of len(text) / len(compressed). Short texts compress less, so each length class has a band of its own.

    whole: (bytes up to, least ratio, greatest ratio), ascending; the last holds for all longer texts.
    chunk_bytes: fixed chunks of the text are compressed on their own; a last chunk under half as long is part of the
    one before. chunk: least and greatest ratio of any chunk_bytes chunk; bad_chunks: a text is rejected if over this
    share of its chunks is outside the band; many_chunks: from how many chunks on which share holds instead.
    """

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = ((512, 1.1, 4.5), (2048, 1.35, 5.5), (8192, 1.45, 6.5), (1 << 62, 1.5, 7.0))
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (1.45, 6.5)
    bad_chunks: float = 0.5
    many_chunks: tuple[int, float] = (8, 0.25)


def base_counts(data: bytes, n_code_points: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = data.split()
    n = len(words)
    # White space is one byte and one code point each; all other code points are in words.
    word_chars = n_code_points - sum(map(data.count, _SPACES))
    symbols = sum(map(data.count, _SYMBOL_BYTES))
    lines = [x for x in data.split(b"\n") if _WORD.search(x)] if b"\n" in data else ()
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < n - 2:
            counts, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 3 - max(end, i)
                    end = i + 3
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeat


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


class BandJudge:
    """Compression ratios of a text and whether they lie in the bands."""

    def __init__(self, bands: Bands):
        self.bands = bands
        self.compress = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=False).compress

    def ratios(self, data: bytes) -> tuple[float | None, list[float]]:
        if not data:
            return None, []
        size = self.bands.chunk_bytes
        whole = len(data) / len(self.compress(data))
        if len(data) <= size:
            return whole, [whole]
        ends = [*(e for e in range(size, len(data), size) if 2 * (len(data) - e) >= size), len(data)]
        chunks = (data[i:e] for i, e in zip([0, *ends], ends))
        return whole, [len(c) / len(self.compress(c)) for c in chunks]

    def passes(self, data: bytes, whole: float | None, chunks: list[float]) -> bool:
        return self.within(len(data), whole, chunks)

    def within(self, n_bytes: int, whole: float | None, chunks: list[float]) -> bool:
        if whole is None:
            return False
        low, high = next((lo, hi) for limit, lo, hi in self.bands.whole if n_bytes <= limit)
        if not low <= whole <= high:
            return False
        if n_bytes <= self.bands.chunk_bytes:
            return True
        low, high = self.bands.chunk
        many, share = self.bands.many_chunks
        return sum(not low <= c <= high for c in chunks) <= (share if len(chunks) >= many else self.bands.bad_chunks) * len(chunks)


#: The bits of a double that each pass over the ratios takes in: those above, after those of the passes before.
_SHIFTS = (44, 33, 22, 11, 0)


def _kinds(clean: DataFrame, bands: Bands) -> DataFrame:
    """(kind, bits): the whole ratio of each text under its length class, and of texts of several chunks the least and
    the greatest chunk under the two kinds that follow; as bits, whose order is that of positive doubles."""
    limits = np.array([limit for limit, _, _ in bands.whole])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, whole, least, most = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            long = size > bands.chunk_bytes
            kind = np.concatenate([np.searchsorted(limits, size), *(np.full(long.sum(), len(limits) + k) for k in (0, 1))])
            bits = np.concatenate([whole, least[long], most[long]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(bits, pa.int64())], names=["kind", "bits"])

    return clean.select("n_bytes", "whole_ratio", "chunk_ratio_min", "chunk_ratio_max").mapInArrow(run, "kind long, bits long")


def _quantiles(values: DataFrame, shares: dict[int, tuple[float, ...]]) -> dict[int, tuple[int, list[float]]]:
    """For each kind how many values there are and, as np.quantile gives them from all, the quantiles at its shares.

    No sample and no sort: each pass counts the values by their next bits, within what holds a wanted rank only, so at
    most a few thousand counts a rank reach the driver, however many values there are. Kinds without values are left out.
    """
    sizes: dict[int, int] = {}
    at: dict[tuple[int, int], tuple[int, int]] = {}  # (kind, rank): bits so far, rank within them
    for before, shift in zip((None, *_SHIFTS), _SHIFTS):
        rows = values
        if before is not None:
            inside = sorted({(kind, bits) for (kind, _), (bits, _) in at.items()})
            rows = values.filter(reduce(or_, ((F.col("kind") == k) & (F.shiftright("bits", before) == b) for k, b in inside), F.lit(False)))
        counted = sorted(tuple(r) for r in rows.groupBy("kind", F.shiftright("bits", shift).alias("bits")).agg(F.count("*")).collect())
        if before is None:
            for kind, _, n in counted:
                sizes[kind] = sizes.get(kind, 0) + n
            at = {(kind, rank): (0, rank) for kind, n in sizes.items() for share in shares[kind] for low in [int((n - 1) * share)] for rank in (low, min(low + 1, n - 1))}
        for (kind, rank), (bits, rest) in at.items():
            for k, b, n in counted:
                if k == kind and (before is None or b >> (before - shift) == bits):
                    if rest < n:
                        at[kind, rank] = b, rest
                        break
                    rest -= n

    def quantile(kind: int, share: float) -> float:
        n = sizes[kind]
        low = int((n - 1) * share)
        part = (n - 1) * share - low
        a, b = (float(np.int64(at[kind, rank][0]).view(np.float64)) for rank in (low, min(low + 1, n - 1)))
        return a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part)

    return {kind: (n, [quantile(kind, share) for share in shares[kind]]) for kind, n in sizes.items()}


def fit_measured(measured: DataFrame, labels: DataFrame, bands: Bands = Bands(), tail: float = 0.001, margin: float = 0.02) -> Bands:
    """fit_bands() on what measure() gave for doc_id; ids and numbers are joined, no texts."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("least"), F.max("quality").alias("most")).filter("least = 1 AND most = 1")
    clean = measured.filter(~F.col("base_failed")).join(known.select("doc_id"), "doc_id")
    values = materialize(_kinds(clean, bands), "quality-clean")
    n = len(bands.whole)
    found = _quantiles(values, {**dict.fromkeys(range(n), (tail, 1 - tail)), n: (tail,), n + 1: (1 - tail,)})
    discard(values)

    def limits(low: int, high: int, old: tuple[float, float]) -> tuple[float, float]:
        if low not in found:
            return old
        size, below = found[low]
        wide = 1 + margin + 0.5 / size**0.5
        return max(old[0], below[0] / wide), min(old[1], found[high][1][-1] * wide)

    whole = tuple((limit, *limits(k, k, (low, high))) for k, (limit, low, high) in enumerate(bands.whole))
    return replace(bands, whole=whole, chunk=limits(n, n + 1, bands.chunk))


def fit_bands(docs: DataFrame, labels: DataFrame, bands: Bands = Bands(), tail: float = 0.001, margin: float = 0.02) -> Bands:
    """bands with limits from ratios of clean text: all labelled rows with quality 1 that held_out() spares.

    The limits of each length class lie where a share ``tail`` of the clean texts is below and as many above, widened
    by the factor 1 + margin + 0.5 / sqrt(n), as the tails of n texts are known so well only; those of the chunks
    likewise, over the least and greatest chunk of each text. Limits only ever get narrower than those of bands, and a
    class without clean texts keeps its own. The quantiles are exact and over every clean text, so reruns agree; ids
    whose labels differ are not used, nulls neither. Only counts of equal leading bits of the ratios reach the driver.
    Without labels, and on empty tables: bands as they are.
    """
    learnt = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out())
    return fit_measured(measure(learnt, bands, carry=["doc_id"]), labels, bands, tail, margin)


_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("whole_ratio", pa.float64()), ("chunk_ratio_min", pa.float64()), ("chunk_ratio_max", pa.float64()), ("kept", pa.bool_())]
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, whole_ratio double, chunk_ratio_min double, chunk_ratio_max double, kept boolean"
#: What measure() gives in place of kept: all that the bands are fitted to and that the verdict needs.
_MEASURED = [*_FIELDS[:-1], ("n_bytes", pa.int64()), ("chunk_ratios", pa.list_(pa.float64()))]
_MEASURED_DDL = _DDL.removesuffix("kept boolean") + "n_bytes long, chunk_ratios array<double>"


def _pass(docs: DataFrame, bands: Bands, text_col: str, carry: list[str] | None, verdict: bool) -> DataFrame:
    fields, made_ddl = (_FIELDS, _DDL) if verdict else (_MEASURED, _MEASURED_DDL)
    keep = [c for c in (docs.columns if carry is None else carry) if c not in {n for n, _ in fields}]
    importable(docs.sparkSession)
    docs, at, ddl = arrow_input(docs, keep, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = BandJudge(bands)
        for batch in batches:
            rows = []
            for value in batch.column(at):
                text = value.as_py() or ""
                data = text.encode("utf-8", "surrogatepass")
                counts = base_counts(data, len(text))
                failed = base_fails(counts[0], counts[4])
                whole, chunks = judge.ratios(data)
                last = (not failed and judge.passes(data, whole, chunks),) if verdict else (len(data), chunks)
                rows.append((*counts, failed, whole, min(chunks, default=whole), max(chunks, default=whole), *last))
            made = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + [pa.array(v, t) for v, (_, t) in zip(made, fields)], names=keep + [n for n, _ in fields])

    return docs.mapInArrow(run, f"{ddl}, {made_ddl}")


def measure(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """As score_quality(), with n_bytes and chunk_ratios (all chunks of the text) in place of kept: no limits are used.

    judge() gives kept from these, so that texts are compressed once though the limits are fitted to their ratios.
    """
    return _pass(docs, bands, text_col, carry, False)


def judge(measured: DataFrame, bands: Bands) -> DataFrame:
    """measured, a result of measure(), with kept in place of n_bytes and chunk_ratios: score_quality()'s result."""
    importable(measured.sparkSession)
    names = [c for c in measured.columns if c not in ("n_bytes", "chunk_ratios")]
    measured = measured.select(*names, "n_bytes", "chunk_ratios")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema.fields[: len(names)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = BandJudge(bands).within
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("base_failed", "n_bytes", "whole_ratio", "chunk_ratios"))
            kept = [not failed and within(*rest) for failed, *rest in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(kept, pa.bool_())], names=[*names, "kept"])

    return measured.mapInArrow(run, f"{ddl}, kept boolean")


def score_quality(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (None: all) and those of _DDL, which replace columns of docs with these names.

    kept is false for texts that fail the base rules (fewer than 50 words, or over half of the words in repeated
    three-word windows) and for texts whose compression ratios leave the bands. One pass, no shuffle, one text in
    memory at a time, whatever its length. Null and empty texts: counts 0, ratios null, base_failed. Repeated rows are
    judged each alone. An empty table gives no rows.
    """
    return _pass(docs, bands, text_col, carry, True)
