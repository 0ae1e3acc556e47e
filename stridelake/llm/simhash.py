"""Operator 5: SimHash near-duplicates with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_input, free_name, importable, materialize, text_bytes
from .components import connected_components

#: Segments of a fingerprint, in a ring, and their bits.
SEGMENTS, SEGMENT_BITS = 4, 16


def simhash(data: bytes, width: int = 3, seed: int = 42, block: int = 1 << 15) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text: bit b is 1 if over half of the shingles' XXH64 have it."""
    words = data.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return 0
    n, h = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for at in range(0, n, block):
        part = words[at : min(at + block, n) + width - 1]
        hashes = [h(s, seed) for s in map(b" ".join, zip(*(part[k:] for k in range(width))))] or [h(b" ".join(part), seed)]
        bits += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (None: doc_id) and fp (long). Null and empty texts: 0."""
    importable(docs.sparkSession)
    carry = [c for c in (carry or ["doc_id"]) if c != "fp"]
    docs, at, ddl = arrow_input(docs, carry, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([simhash(x, width, seed) for x in text_bytes(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], fp], names=[*carry, "fp"])

    return docs.mapInArrow(run, f"{ddl}, fp long")


def _ring(i: str) -> str:
    """fp turned so that segment i is lowest."""
    return f"(shiftrightunsigned(fp, {SEGMENT_BITS} * {i}) | shiftleft(fp, 64 - {SEGMENT_BITS} * {i}))"


def near_pairs(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints of prints (fp, distinct) that differ in 3 bits or fewer.

    Pigeonring: with 4 segments in a ring and 3 differing bits, some segment starts a chain whose first l segments
    differ in at most 3 * l / 4 bits for every l: 0, 1, 2 and 3 bits. The first two conditions are looked up: the
    segment that starts the chain equal and the next one equal or one bit off, 17 probes for each start against one
    index row, which is a 32-bit key; the third prunes what the key finds, and the full distance decides. The rows
    that are shuffled are 72 for each fingerprint however many documents share it.
    """
    index = prints.selectExpr("fp AS b", f"explode(sequence(0, {SEGMENTS - 1})) AS i", "fp").selectExpr("b", f"shiftleft(CAST(i AS BIGINT), 32) | ({_ring('i')} & 4294967295) AS key")
    probe = prints.selectExpr("fp", f"explode(sequence(0, {SEGMENTS * (SEGMENT_BITS + 1) - 1})) AS k").selectExpr("fp", f"k div {SEGMENT_BITS + 1} AS i", f"CAST(k % {SEGMENT_BITS + 1} AS INT) AS v")
    probe = probe.selectExpr("fp", "CAST(i AS INT) AS i", "v").selectExpr("fp AS a", f"shiftleft(CAST(i AS BIGINT), 32) | (({_ring('i')} & 4294967295) ^ IF(v = 0, 0L, shiftleft(1L, v + {SEGMENT_BITS - 1}))) AS key")
    # The third segment of the chain: bits 32 to 47 of the turned difference.
    turned = "(shiftrightunsigned(a ^ b, 16 * CAST(shiftrightunsigned(key, 32) AS INT)) | shiftleft(a ^ b, 64 - 16 * CAST(shiftrightunsigned(key, 32) AS INT)))"
    found = probe.join(index, "key").filter("a < b").filter(f"bit_count({turned} & 281474976710655L) <= 2 AND bit_count(a ^ b) <= 3")
    return found.select("a", "b").distinct()


def near_duplicates(prints: DataFrame) -> DataFrame:
    """doc_id, fp, root, component_id of prints (doc_id, fp), which should be a table: it is read several times.

    Equal fingerprints are one node, so a group of copies costs one lookup. root names the group; component_id is the
    smallest doc_id in it (null if none of its rows has an id). Texts without words share the fingerprint 0 and link
    like any other. Rows that repeat an id each keep their own fingerprint. Empty table: no rows.
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    roots = connected_components(near_pairs(nodes.select("fp")))
    nodes = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = materialize(nodes, "print-roots")
    # Written, so that both sides of the join by root are shuffled for it alone and Spark can split a large group.
    groups = materialize(nodes.groupBy("root").agg(F.min("least_id").alias("component_id")), "print-groups")
    return prints.join(nodes.select("fp", "root").join(groups, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without all but one document of each group of near-duplicates: the one with the smallest doc_id stays.

    Documents without an id come last, and of rows that repeat the winner's id and fingerprint one stays. A column
    named fp keeps its content. Most rows pass an anti-join with the keys that lose or repeat; texts are shuffled
    for it at most once.
    """
    columns = docs.columns
    kept_fp, flag, number = (free_name(docs, n) for n in ("__fp", "__null", "__id"))
    named = docs.withColumnRenamed("fp", kept_fp)
    printed = materialize(fingerprints(named, text_col=text_col, carry=named.columns), "printed")
    keys = near_duplicates(printed.select("doc_id", "fp")).groupBy("doc_id", "fp", "root").agg(F.count("*").alias("n"))
    keys = materialize(keys, "print-keys")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("fp"))
    firsts = materialize(keys.groupBy("root").agg(F.min(rank).alias("first")), "print-firsts")  # as in near_duplicates()
    keys = keys.join(firsts, "root").withColumn("wins", rank == F.col("first"))
    no_id = F.lit(-(1 << 63))  # stands for null in the join, beside a flag
    key = [F.coalesce("doc_id", no_id).alias(number), F.col("doc_id").isNull().alias(flag), F.col("fp")]
    lost = keys.filter("NOT wins OR n > 1").select(*key)
    again = keys.filter("wins AND n > 1").select(*key)
    rows = printed.select("*", *key[:2])
    on = [number, flag, "fp"]
    once = rows.join(lost, on, "left_anti")
    first = rows.join(again, on, "left_semi").dropDuplicates(on)
    return once.unionByName(first).select(*(kept_fp if c == "fp" else c for c in columns)).toDF(*columns)


def fingerprint_hex(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
