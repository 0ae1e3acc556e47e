"""Python workers of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Let Python workers that the session starts from now on import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH", ""))))


def work_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share and that goes when the driver ends.

    It lies in spark.checkpoint.dir if that is set to a mounted folder, else (one machine) in the temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared and "://" in shared and not shared.startswith("file://"):
        raise ValueError("arrays are written at places within a file, which takes a mounted folder")
    parent = (shared or "").removeprefix("file://") or None
    if parent:
        os.makedirs(parent, exist_ok=True)
    made = tempfile.mkdtemp(prefix="stridelake-", dir=parent)
    os.chmod(made, 0o755)
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def dense_index(df: DataFrame, *order: str, name: str = "flat_index") -> DataFrame:
    """df with its rows numbered from 0 in an order, by a range sort and one offset per partition.

    The sorted rows are written once, with their partition and place, so that later reads agree.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/rows"
    place = F.monotonically_increasing_id()
    own = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.shiftright(place, 33)).withColumn("__at", place.bitwiseAND(F.lit((1 << 33) - 1)))
    own.write.parquet(f"file://{path}")
    rows = spark.read.schema(own.schema).parquet(f"file://{path}")
    counts = {r["__part"]: r["n"] for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    starts, total = [], 0
    for part in sorted(counts):
        starts += [F.lit(part), F.lit(total)]
        total += counts[part]
    start = F.create_map(*starts)[F.col("__part")] if starts else F.lit(0)
    return rows.withColumn(name, (start + F.col("__at")).cast("long")).drop("__part", "__at")
