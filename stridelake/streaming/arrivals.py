"""A stream of .npy files that arrive in a folder (an extension: files are read whole, once each)."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.decode import to_arrow
from ..sources.dtypes import numpy_dtype
from ..sources.header import read_header
from ..workers import importable


def decode_binary(files: DataFrame, value_type: str) -> DataFrame:
    """(path, flat_index, value) from rows (path, content), each content a whole .npy file. Batch or stream."""
    importable(files.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                header = read_header(io.BytesIO(data), data.size)
                x = np.frombuffer(data, numpy_dtype(header.dtype), offset=header.data_offset)
                for at in range(0, len(x), 1 << 16):
                    part = x[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(at, at + len(part))), to_arrow(part, header.dtype)], names=["path", "flat_index", "value"])

    return files.select("path", "content").mapInArrow(run, f"path string, flat_index long, value {value_type}")


def read_arrivals(spark: SparkSession, folder: str, value_type: str) -> DataFrame:
    """A streaming DataFrame of the items of every .npy file that appears in folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.npy").load(folder)
    return decode_binary(files, value_type)
