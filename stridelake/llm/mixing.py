"""Operator 3: mixing sources to target weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, materialize

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)


def mix_key(seed: str, id_col: str = "doc_id") -> Column:
    """Hash-random key of a document: the same in every run with the same seed."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source_col: str = "source") -> Column:
    """A join key that is never null: null sources form one source of their own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))


def source_targets(sizes: DataFrame, ratio: float, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: source_size, target (double), budget (whole words).

    sizes: (skey, source, size). Weights go to the sources by code point, nulls last. All targets together are
    ratio times all sizes; a target stops at max_epochs times its source's size and the others share the rest by
    weight, which has a closed form: with sources in order of max_epochs * size / weight, those before the first
    source that a common level lambda satisfies are at their limit, and the others get weight * lambda.
    """
    per = sizes.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    # One row per source from here on: the table has as many rows as there are sources, not documents.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_level = Window.orderBy("level", "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("level", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = F.lit(max_epochs) * F.col("source_size")
    t = per.withColumn("weight", w).withColumn("level", most / F.col("weight"))
    t = (
        t.withColumn("full_before", F.sum(most).over(by_level) - most)
        .withColumn("weight_left", F.sum("weight").over(every) - F.sum("weight").over(by_level) + F.col("weight"))
        .withColumn("lam", (F.lit(ratio) * F.sum("source_size").over(every) - F.col("full_before")) / F.col("weight_left"))
        .withColumn("common", F.first(F.when(F.col("lam") <= F.col("level"), F.col("lam")), ignorenulls=True).over(every))
    )
    t = t.withColumn("target", F.when(F.col("common").isNull() | (F.col("common") >= F.col("level")), most.cast("double")).otherwise(F.col("common") * F.col("weight")))
    return t.select("skey", "source_size", "target", F.least(F.round("target").cast("long"), most.cast("long")).alias("budget"))


def mix_sources(
    docs: DataFrame,
    ratio: float = 1.5,
    max_epochs: int = 2,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Row per document: doc_id, source, mix_key, size, source_size, target, budget, start, taken.

    Documents of a source stand in the order of their hash keys; ``start`` is the number of the source's words
    before the document. The mix runs through the source budget // source_size times and then takes the first
    budget % source_size words of that order, so each source gets its budget exactly and one document at most is
    taken in part. Text does not travel: only ids, keys and sizes are shuffled, by source and a leading part of the
    key (a range of keys), so a source with a third of all rows is spread over all tasks. Offsets of the ranges are
    prefix sums over ranges; those within a range a running sum.

    Null or empty text: size 0, taken 0. Null source: a source of its own, ranked last. Rows that repeat an id have
    the same key and stand next to each other, the smaller first. No documents: no rows.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), source_key(source_col).alias("skey"), mix_key(seed, id_col).alias("mix_key"), word_count(text_col).alias("size")
    )
    slim = materialize(slim, "mix-sizes")
    digits = max(2, math.ceil(math.log(max(1, slim.count() / 100_000), 16)))
    slim = slim.withColumn("key_range", F.substring("mix_key", 1, digits))
    ranges = slim.groupBy("skey", "key_range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("skey").orderBy("key_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.select("skey", "key_range", (F.sum("words").over(before) - F.col("words")).alias("range_start"))
    info = ranges.join(source_targets(slim, ratio, max_epochs, weights), "skey")
    within = Window.partitionBy("skey", "key_range").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slim.join(info, ["skey", "key_range"]).withColumn("start", F.col("range_start") + F.sum("size").over(within) - F.col("size"))
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - whole * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "mix_key", "size", "source_size", "target", "budget", "start", (whole * F.col("size") + part).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_sources: int = 100_000, seed: str = "mix-1", **kw) -> DataFrame:
    """docs as the mix takes them: a row for every pass over a document, with docs' columns, and none for the others.

    Texts stay whole: the one document of a source at which its budget ends is taken in the last pass if at least
    half of it lies before the end, so a source comes within half a document of its budget. Where the passes end is
    one row per source, which is sent to all tasks if there are at most most_sources; texts are not shuffled, but for
    those of rows that repeat the id and size of the last row taken: they are numbered, to take as many as the mix
    does. Null, empty and blank texts are never taken; a null source is a source of its own; long texts are counted in
    the JVM and not copied. No documents: no rows.
    """
    placed = materialize(mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **kw).withColumn("skey", source_key("source")), "mix-placed")
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    last = F.col("taken") - whole * F.col("size")
    rank = F.struct(F.col("mix_key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"))
    skey, whole_col, end, copies, passes, one_pass = (free_name(docs, n) for n in ("__skey", "__whole", "__end", "__copies", "__passes", "__pass"))
    taken = placed.filter((last > 0) & (2 * last >= F.col("size")))
    wholes = placed.groupBy(F.col("skey").alias(skey)).agg(F.max(whole).alias(whole_col))
    last_taken = taken.groupBy("skey").agg(F.max(rank).alias(end))
    equal = taken.join(last_taken, "skey").filter(rank == F.col(end)).groupBy(F.col("skey").alias(skey), end).agg(F.count("*").alias(copies))
    ends = materialize(wholes.join(equal, skey, "left"), "mix-ends")
    if ends.count() <= most_sources:
        ends = F.broadcast(ends)
    own = F.struct(mix_key(seed, id_col), F.coalesce(F.col(id_col).cast("string"), F.lit("")), word_count(text_col))
    rows = docs.withColumn(skey, source_key(source_col)).join(ends, skey).filter(word_count(text_col) > 0)
    at_end = F.col(end).isNotNull() & (own == F.col(end))
    number = F.row_number().over(Window.partitionBy(skey).orderBy(text_col))
    others = rows.filter(~at_end).withColumn(passes, F.col(whole_col) + F.when(F.col(end).isNotNull() & (own < F.col(end)), 1).otherwise(0))
    edge = rows.filter(at_end).withColumn(passes, F.col(whole_col) + F.when(number <= F.col(copies), 1).otherwise(0))
    rows = others.unionByName(edge).withColumn(passes, F.col(passes).cast("int")).filter(F.col(passes) > 0)
    return rows.withColumn(one_pass, F.explode(F.sequence(F.lit(1), F.col(passes)))).select(*docs.columns)
