"""N-dimensional arrays over DataFrames of items."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import Errors, NdError
from ..functions.index import checked_size, normalized, ravel, strides, unravel
from ..sources.blocks import summarize, transform_file
from ..sources.catalog import read_properties
from ..sources.npy_source import read_npy
from ..sources.sink import save_npy


@dataclass(frozen=True)
class NDFrame:
    """Items (flat_index, value) in storage order, with a shape. Every operation gives a new frame and runs nothing
    until rows are asked for."""

    items: DataFrame
    shape: tuple[int, ...]
    fortran_order: bool = False
    #: Gives the items from a first to before a last one, where a reader can start there.
    ranged: Callable[[int, int], DataFrame] | None = None
    #: The file whose items these are, unchanged.
    path: str | None = None

    def _derive(self, f: Callable[[DataFrame], DataFrame]) -> NDFrame:
        ranged = self.ranged
        return replace(self, items=f(self.items), ranged=(lambda b, e: f(ranged(b, e))) if ranged else None, path=None)

    def between(self, begin: int, end: int) -> DataFrame:
        """Items begin to before end; a file is read from there only."""
        if self.ranged:
            return self.ranged(begin, end)
        return self.items.filter((F.col("flat_index") >= begin) & (F.col("flat_index") < end))

    # Construction

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> NDFrame:
        header = read_properties(path)
        return cls(read_npy(spark, path, "items", **options), header.shape, header.fortran_order, lambda b, e: read_npy(spark, path, "items", begin=b, end=e, **options), path)

    @classmethod
    def full(cls, spark: SparkSession, shape: Sequence[int], value: Column | float = 0.0, fortran_order: bool = False) -> NDFrame:
        n = checked_size(shape)
        return cls(spark.range(n).select(F.col("id").alias("flat_index"), (value if isinstance(value, Column) else F.lit(value)).alias("value")), tuple(shape), fortran_order)

    @classmethod
    def from_rows(cls, rows: DataFrame, index: str, values: str, width: int, n_rows: int) -> NDFrame:
        """A matrix from a table with a dense row number and an array column of one width."""
        items = rows.select(F.col(index).cast("long").alias("i"), F.posexplode(values).alias("k", "value")).select((F.col("i") * width + F.col("k")).alias("flat_index"), "value")
        return cls(items, (n_rows, width))

    def save(self, path: str, **options) -> str:
        return save_npy(self.items, path, shape=self.shape, fortran_order=self.fortran_order, **options)

    # Metadata

    @property
    def size(self) -> int:
        return checked_size(self.shape)

    @property
    def strides(self) -> tuple[int, ...]:
        return strides(self.shape, self.fortran_order)

    @property
    def dtype(self):
        return self.items.schema["value"].dataType

    # Indices and points

    def indexed(self, prefix: str = "i") -> DataFrame:
        """Items with one index column per axis: i0, i1, ..."""
        at = unravel(F.col("flat_index"), self.shape, self.fortran_order)
        return self.items.select("flat_index", *(c.alias(f"{prefix}{k}") for k, c in enumerate(at)), "value")

    def _flat(self, index: Sequence[int]) -> int:
        return sum(i * s for i, s in zip(normalized(index, self.shape), self.strides))

    def get(self, *index: int) -> DataFrame:
        """One item as a row; negative indices count from the end, NdError 602 or 603 for others."""
        at = self._flat(index)
        return self.between(at, at + 1)

    def value(self, *index: int):
        row = self.get(*index).first()
        return None if row is None else row["value"]

    def gather(self, indices: DataFrame, *axes: str) -> DataFrame:
        """Rows of indices (a column per axis) with the value there: one join on the flat index. Rows out of range are lost."""
        inside = reduce(lambda a, b: a & b, (F.col(c).between(-n, n - 1) for c, n in zip(axes, self.shape)))
        wrapped = [F.when(F.col(c) < 0, F.col(c) + n).otherwise(F.col(c)) for c, n in zip(axes, self.shape)]
        return indices.filter(inside).withColumn("flat_index", ravel(wrapped, self.shape, self.fortran_order)).join(self.items, "flat_index")

    def set(self, index: Sequence[int], value: Column | float) -> NDFrame:
        at = self._flat(index)
        new = (value if isinstance(value, Column) else F.lit(value)).cast(self.dtype)
        return self._derive(lambda d: d.withColumn("value", F.when(F.col("flat_index") == at, new).otherwise(F.col("value"))))

    def field(self, *names: str) -> NDFrame:
        """Frame of a field, or of a field of a field; an error that names the path if there is none."""
        here = self.dtype
        for n in names:
            if not hasattr(here, "names") or n not in here.names:
                raise NdError(Errors.invalid_value, "Field not found: /" + "/".join(names))
            here = here[n].dataType
        return self._derive(lambda d: d.select("flat_index", reduce(lambda c, n: c[n], names, F.col("value")).alias("value")))

    # Elements

    def apply(self, f: Callable[[Column], Column]) -> NDFrame:
        """Every value replaced by f of it."""
        return self._derive(lambda d: d.select("flat_index", f(F.col("value")).alias("value")))

    def apply_arrow(self, f, value_type: str) -> NDFrame:
        """apply for what expressions can't do: f maps an Array of values to one of the same length, batch by batch."""
        import pyarrow as pa

        def run(batches):
            for b in batches:
                out = f(b.column(1))
                if len(out) != b.num_rows:
                    raise NdError(Errors.item_size_mismatch, f"{len(out)} values for {b.num_rows}")
                yield pa.RecordBatch.from_arrays([b.column(0), out], names=["flat_index", "value"])

        return self._derive(lambda d: d.select("flat_index", "value").mapInArrow(run, f"flat_index long, value {value_type}"))

    def transform(self, f: Callable[[Column], Column], *index: int) -> DataFrame:
        """f of one item; the array stays as it is."""
        return self.get(*index).select(f(F.col("value")).alias("value"))

    def map(self, f: Callable[[Column, Column], Column], name: str = "out") -> DataFrame:
        """f of each value and its flat index."""
        return self.items.select("flat_index", f(F.col("value"), F.col("flat_index")).alias(name))

    def limit_items(self, n: int, begin: int = 0) -> DataFrame:
        """Items begin to begin + n in storage order."""
        return self.between(begin, begin + n)

    def seek(self, k: int) -> DataFrame:
        """Items from k on; k may be the number of items. NdError 504 beyond."""
        if not 0 <= k <= self.size:
            raise NdError(Errors.invalid_item_offset, str(k))
        return self.between(k, self.size)

    def __iter__(self) -> Iterator[Row]:
        """Items in storage order, one partition at a time on the driver."""
        return self.items.orderBy("flat_index").toLocalIterator()

    # Aggregates

    def _summary(self) -> Row | None:
        """Partial aggregates of the file's blocks, for plain numbers that nothing has changed."""
        kind = self.dtype.simpleString()
        if not self.path or kind not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal(20,0)"):
            return None
        return summarize(self.items.sparkSession, self.path).first()

    def max(self, skip_nan: bool = False):
        """The largest value, null for an array without items. NaN is the greatest unless skipped."""
        if found := self._summary():
            if found["n_nan"] and not skip_nan:
                return float("nan")
            return found["high"] if found["high"] is None or isinstance(found["high"], float) else int(found["high"])
        rows = self.items.filter(~F.isnan("value")) if skip_nan else self.items
        return rows.agg(F.max("value")).first()[0]

    def sum(self):
        """The sum of all values, exact for integers; null for an array without items."""
        if found := self._summary():
            if found["n_nan"]:
                return float("nan")
            return found["total"] if found["total"] is None or isinstance(found["total"], float) else int(found["total"])
        return self.items.agg(F.sum("value")).first()[0]

    def apply_blocks(self, f, target: str, typestr: str | None = None, overwrite: bool = False) -> NDFrame:
        """apply for whole files: f maps NumPy blocks, and the result is the file target, loaded."""
        if not self.path:
            raise NdError(Errors.unavailable, "blocks are those of a file; save the array first")
        spark = self.items.sparkSession
        return NDFrame.load(spark, transform_file(spark, self.path, target, f, typestr, overwrite))

    def fold(self, aggregate: Callable[[Column], Column]):
        """An order-free fold: any aggregate of the value column."""
        return self.items.agg(aggregate(F.col("value"))).first()[0]

    def fold_ordered(self, start: Column, merge: Callable[[Column, Column], Column], along: int) -> DataFrame:
        """A fold in storage order within each run of ``along`` items (the last axis): (row, value).

        Each run is gathered on its own, so ``along`` bounds what a task holds; runs are spread over all tasks.
        """
        runs = self.items.groupBy(F.call_function("div", F.col("flat_index"), F.lit(along).cast("long")).alias("row")).agg(F.sort_array(F.collect_list(F.struct("flat_index", "value"))).alias("run"))
        return runs.select("row", F.aggregate(F.col("run.value"), start, merge).alias("value"))

    # Shape

    def reshape(self, *shape: int) -> NDFrame:
        """The same items in storage order under another shape of the same size (else NdError 601). No rows move."""
        if checked_size(shape) != self.size:
            raise NdError(Errors.invalid_value, f"{self.shape} has {self.size} items, {shape} has {checked_size(shape)}")
        return replace(self, shape=tuple(shape))  # what is known of the file holds for any shape

    def rows(self) -> DataFrame:
        """(i0, values): the items of each index of the first axis, in row-major order."""
        per = self.size // max(1, self.shape[0])
        at = [F.col(f"i{k}") for k in range(1, len(self.shape))]
        place = ravel(at, self.shape[1:]) if at else F.lit(0).cast("long")
        grouped = self.indexed().groupBy("i0").agg(F.sort_array(F.collect_list(F.struct(place.alias("k"), "value"))).alias("run"))
        return grouped.select("i0", F.col("run.value").alias("values")) if per else grouped.select("i0", F.array().alias("values"))

    def text(self, indent: str = "", f: Callable[[object], object] = lambda v: v, most: int = 10_000) -> str:
        """Nested brackets for a small array; NdError 601 beyond ``most`` items."""
        if self.size > most:
            raise NdError(Errors.invalid_value, f"{self.size} items are too many to print")
        if not self.shape:
            return "[]"
        cells = {r["flat_index"]: f(r["value"]) for r in self.items.collect()}

        def level(prefix: tuple[int, ...]) -> str:
            d, n = len(prefix), self.shape[len(prefix)]
            if d == len(self.shape) - 1:
                return "[" + ", ".join(f"{cells[self._flat((*prefix, k))]!s:>2}" for k in range(n)) + "]"
            return (indent if d == 0 else "") + "[" + f",\n{indent}{' ' * (d + 1)}".join(level((*prefix, k)) for k in range(n)) + "]"

        return level(())
