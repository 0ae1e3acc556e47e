"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers that this session starts import the package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH", ""))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset (tests), a new local one."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        made = tempfile.mkdtemp(prefix="stridelake-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir(f"file://{made}")
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing will read it again."""
    spark, path = df.sparkSession, getattr(df, "shared_path", None)
    if path:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the ids that no model learns from; null ids are never learnt from either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 of each value, b"" for null, without decoding."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_input(docs: DataFrame, carry: list[str], text_col: str) -> tuple[DataFrame, int, str]:
    """docs with the columns carry first and the text somewhere, where the text is, and the DDL of carry.

    A text that is carried anyway is sent to Python once.
    """
    if text_col in carry:
        docs, at = docs.select(*(docs[c] for c in carry)), carry.index(text_col)
    else:
        docs, at = docs.select(*(docs[c] for c in carry), docs[text_col].alias(free_name(docs, "__text"))), len(carry)
    return docs, at, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[: len(carry)])
