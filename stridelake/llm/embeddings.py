"""Operator 7: embedding near-duplicates by randomised-rotation binary codes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, materialize
from .components import connected_components


def rotation(dims: int, k: int, seed: int = 11) -> np.ndarray:
    """The k-th random rotation: the orthogonal factor of a Gaussian matrix, with signs that make it uniform."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dims, k)).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their codes (signs) and correction factors: the product of each vector with its code.

    unit: rows of length 1. A code stands for the unit vector sign / sqrt(dims).
    """
    turned = unit @ turn.T
    signs = turned >= 0
    return turned, signs, np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def estimate(signs: np.ndarray, factors: np.ndarray, turned: np.ndarray, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded rows with turned rows, and half the width of their bounds.

    The product of a query with the code, over the code's own factor, has the inner product as its mean over random
    rotations; what is left is a product with a direction at random, of deviation 1 / sqrt(dims - 1) at most.
    """
    dims = turned.shape[1]
    values = np.where(signs, 1.0, -1.0).astype(np.float32) @ turned.T.astype(np.float32) / (math.sqrt(dims) * factors[:, None])
    half = sigmas * np.sqrt(np.maximum(1 - factors**2, 0)) / factors / math.sqrt(max(dims - 1, 1))
    return values, half[:, None]


def plan_tables(n: int, cosine: float, miss: float, bucket: int) -> tuple[int, int]:
    """(bits of a key, number of keys) so that random buckets hold about ``bucket`` vectors and a pair at exactly
    ``cosine`` shares no key with probability ``miss`` at most."""
    same = 1 - math.acos(cosine) / math.pi
    bits = max(4, round(math.log2(max(n, 1) / bucket))) if n > bucket else 4
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same**bits)))


def _rotations(dims: int, total_bits: int) -> np.ndarray:
    return np.concatenate([rotation(dims, k) for k in range(1, 1 + math.ceil(total_bits / dims))])[:total_bits]


def _valid(values: list | None) -> np.ndarray | None:
    """The vector as float32 where that holds its values, else as float64; None if it links with nothing."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    x = x + 0.0
    least, most = np.abs(x[x != 0]).min(), np.abs(x).max()
    if least >= 2.0**-126 and most < 2.0**127 and (x == x.astype(np.float32)).all():
        return x.astype(np.float32)
    return x


def _data(x: np.ndarray) -> bytes:
    """Bytes of a vector, the first of them its type, so that equal vectors have equal bytes."""
    return (b"f" if x.dtype == np.float32 else b"d") + x.tobytes()


def _vector(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f4" if data[:1] == b"f" else "<f8", offset=1).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of their largest component, so that no length over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def class_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, class, vector): equal vectors have equal classes; class and vector are null for invalid vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_valid(v) for v in batch.column(1).to_pylist()]
            data = [None if x is None else _data(x) for x in made]
            cls = [None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "class", "vector"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector_col).mapInArrow(run, "vec_id long, class binary, vector binary")


def key_rows(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(class, keys, code, factor): the integer keys of each class, a key for each table from bits of rotated signs of
    its own, and the binary code under another rotation with its correction factor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        places = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            by_dims: dict[int, list[int]] = {}
            data = batch.column(1).to_pylist()
            for row, d in enumerate(data):
                by_dims.setdefault((len(d) - 1) // (4 if d[:1] == b"f" else 8), []).append(row)
            keys, codes, factor = np.zeros((len(data), tables), np.int64), [b""] * len(data), np.zeros(len(data))
            for dims, rows in by_dims.items():
                if dims not in turns:
                    turns[dims] = _rotations(dims, bits * tables), rotation(dims, 0)
                x = _units(np.array([_vector(data[r]) for r in rows]))
                keys[rows] = ((x @ turns[dims][0].T >= 0).reshape(len(rows), tables, bits) @ places) ^ (dims << 40)
                _, signs, factor[rows] = encode(x, turns[dims][1])
                for r, packed in zip(rows, np.packbits(signs, axis=1)):
                    codes[r] = packed.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(keys), pa.list_(pa.int64())), pa.array(codes, pa.binary()), pa.array(factor)], names=["class", "keys", "code", "factor"])

    return classes.select("class", "vector").mapInArrow(run, "class binary, keys array<long>, code binary, factor double")


def _forest(linked: np.ndarray) -> np.ndarray:
    """The smallest row that links reach, for each row of a symmetric matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of a binary column whose values have one length, as a matrix."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(n, -1)


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of a column of _data() of vectors of one length, as a matrix."""
    if len(set(pc.binary_length(column).to_pylist())) > 1:  # float32 and float64
        return np.array([_vector(d) for d in column.to_pylist()])
    raw = _matrix(column, "u1")
    kind = "<f4" if raw[0, 0] == ord("f") else "<f8"
    if (raw[:, 0] != raw[0, 0]).any():  # as many bytes, but another type: another length
        raise ValueError("vectors of different lengths in a unit")
    return np.ascontiguousarray(raw[:, 1:]).view(kind).astype(np.float64)


def compare_units(units: DataFrame, cosine: float, sigmas: float) -> DataFrame:
    """(class, links, other) from units, rows (table, key, i, j, block, class, copies, keys, code, factor, vector)
    sorted by the first four, which name the unit, and by class; keys are those of the tables before.

    A unit holds one or two blocks of a bucket. For every class, links is the number of vectors of other classes
    that it links with in this unit and with which it shares no key of an earlier table, so that each pair counts
    once however many buckets it shares; other is the smallest class that it hangs together with here. Pairs whose
    upper bound on the estimate is below the limit are not computed; all others are, in double precision.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}

        def compare(unit: pa.RecordBatch) -> pa.RecordBatch | None:
            n = unit.num_rows
            x = _units(_vectors(unit.column("vector")))
            dims = x.shape[1]
            if dims not in turns:
                turns[dims] = rotation(dims, 0)
            signs = np.unpackbits(_matrix(unit.column("code"), "u1"), axis=1, count=dims).astype(bool)
            value, half = estimate(signs, unit.column("factor").to_numpy(), x @ turns[dims].T, sigmas)
            maybe = value + half >= cosine
            maybe = np.triu(maybe | maybe.T, 1)  # as either may be the coded one: the same pairs in every bucket
            block = unit.column("block").to_numpy()
            if block.min() != block.max():  # pairs within a block belong to the unit of that block alone
                maybe &= block[:, None] != block[None, :]
            a, b = np.nonzero(maybe)
            exact = np.zeros(len(a), bool)
            for at in range(0, len(a), 1 << 16):
                part = slice(at, at + (1 << 16))
                exact[part] = np.einsum("ij,ij->i", x[a[part]], x[b[part]]) >= cosine
            a, b = a[exact], b[exact]
            if not len(a):
                return None
            keys, copies = unit.column("keys").flatten().to_numpy().reshape(n, -1), unit.column("copies").to_numpy()
            first = np.ones(len(a), bool)
            for t in range(unit.column("table")[0].as_py()):
                first &= keys[a, t] != keys[b, t]
            links = np.bincount(a[first], copies[b[first]], n) + np.bincount(b[first], copies[a[first]], n)
            linked = np.zeros((n, n), bool)
            linked[a, b] = linked[b, a] = True
            keep = pa.array(np.nonzero(linked.any(1))[0])
            names = unit.column("class")
            return pa.RecordBatch.from_arrays([names.take(keep), pa.array(links[keep.to_numpy()].astype(np.int64)), names.take(pa.array(_forest(linked)[keep.to_numpy()]))], names=["class", "links", "other"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            name = np.stack([batch.column(c).to_numpy() for c in ("table", "key", "i", "j")], 1)
            if not len(name):
                continue
            edges = [0, *(np.nonzero((name[1:] != name[:-1]).any(1))[0] + 1).tolist(), len(name)]
            for begin, end in zip(edges, edges[1:]):
                if last is not None and (name[begin] != last).any():
                    whole = held[0] if len(held) == 1 else pa.concat_batches(held)
                    if whole.num_rows > 1 and (out := compare(whole)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(begin, end - begin))
                last = name[begin]
        if held:
            whole = held[0] if len(held) == 1 else pa.concat_batches(held)
            if whole.num_rows > 1 and (out := compare(whole)) is not None:
                yield out

    return units.mapInArrow(run, "class binary, links long, other binary")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.9, miss: float = 0.01, bucket: int = 24, block: int = 512, sigmas: float = 4.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of vectors.

    Equal vectors are one class with a number of copies. Each class gets keys from signs under random rotations;
    classes that share a key meet in a bucket, where binary codes with correction factors estimate their cosine and
    bounds decide which pairs are computed exactly. A pair at exactly the limit shares no key with probability
    miss at most; pairs that are closer are missed far more rarely, and pairs below the limit are never linked.
    Keys get longer with log2 of the number of classes, so random buckets keep their size, and vectors are shuffled
    once for each table. A bucket of over block classes is dealt out in blocks, and each two blocks form a unit: no
    task holds more than two blocks of one bucket, and of the pairs only counts and a spanning forest leave a unit.

    Vectors that are null, empty or zero, or hold null or non-finite values: no links, a component of their own.
    Vectors of different length don't link. Rows that repeat an id are vectors of their own, and component_id is
    the smallest id, null for those without. Empty table: no rows.
    """
    spark = vectors.sparkSession
    importable(spark)
    rows = materialize(class_rows(vectors, id_col, vector_col), "vectors")
    valid = rows.filter(F.col("class").isNotNull())
    classes = materialize(valid.groupBy("class").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.min("vector").alias("vector")), "vector-classes")
    bits, tables = plan_tables(classes.count(), cosine, miss, bucket)
    keyed = materialize(key_rows(classes, bits, tables), "vector-keys")
    met = keyed.select("class", F.posexplode("keys").alias("table", "key"))
    sizes = met.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = met.join(sizes, ["table", "key"]).withColumn("block", F.pmod(F.xxhash64("class", "table"), F.col("blocks")).cast("int"))
    met = met.select("class", "table", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with_block"))
    met = met.select("class", "table", "key", F.least("block", "with_block").alias("i"), F.greatest("block", "with_block").alias("j"), "block")
    full = met.join(classes.select("class", "copies", "vector").join(keyed, "class"), "class")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(classes.count() * tables / 20_000))
    unit = ["table", "key", "i", "j"]
    full = full.withColumn("keys", F.slice("keys", F.lit(1), F.col("table")))  # those of earlier tables tell which pairs are new
    units = full.repartition(parts, *unit).sortWithinPartitions(*unit, "class")
    found = materialize(compare_units(units.select(*unit, "block", "class", "copies", "keys", "code", "factor", "vector"), cosine, sigmas), "vector-links")

    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("class").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "class")
    info = classes.drop("vector").join(links, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    info = materialize(info, "vector-roots")
    # Written, so that both sides of the join by root are shuffled for it alone and Spark can split a large component.
    groups = materialize(info.groupBy("root").agg(F.min("least_id").alias("component_id")), "vector-groups")
    info = info.join(groups, "root")
    info = info.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "class").join(info, "class", "left")
    own = F.col("class").isNull()
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(own, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(own, F.lit(True)).otherwise(F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).alias("kept"),
    )
