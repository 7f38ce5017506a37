"""Tables written to the folder that the driver and all executors share.

Cutting lineage with a written table keeps a lost executor from recomputing the
whole chain, and gives the planner true sizes for what follows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_dir

#: Rows and bytes that go to a Python worker at once: long texts must not pile up there.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def small_batches(spark: SparkSession):
    """Small Arrow batches for what is run inside."""
    was = {k: spark.conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Every batch in slices of at most ``most`` bytes of ``column``, or of one longer row: whoever writes the result sets the size of batches."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(b):
            upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right"))
            end = max(upto, at + 1)
            yield b.slice(at, end - at)
            at = end


class Workspace:
    """Written tables of one run of an operator, under a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidewheel/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def save(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{label}"
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidewheel_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for df in saved:
            path = jvm.org.apache.hadoop.fs.Path(df._tidewheel_path)
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            fs.delete(path, True)
