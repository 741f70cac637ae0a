"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a batch that are turned into Python objects at a time, and about how many bytes of text.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for what a job writes on its way: spark.checkpoint.dir. Only in local mode, where driver and
    executors are one process, a folder of our own stands in for it; on a cluster an unset one is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = f"file://{tempfile.mkdtemp(prefix='standmill-')}"
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def _stored(df: DataFrame, path: str, *by: str) -> DataFrame:
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: cuts the lineage, and survives lost executors."""
    return _stored(df, f"{work_dir(df.sparkSession)}/{uuid.uuid4().hex}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A function like ``written``, also by columns in folders of their own, whose tables are deleted at the end: what is to stay
    must have been written elsewhere by then."""
    root = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    try:
        yield lambda df, *by: _stored(df, f"{root}/{uuid.uuid4().hex}", *by)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def carried(docs: DataFrame) -> "F.Column":
    """All columns of docs but text as one struct, ``kept``: on its way through an operator no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text"]).alias("kept")


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, from ``text`` and ``kept``."""
    return df.select(*[F.col("text") if c == "text" else F.col("kept").getField(c).alias(c) for c in docs.columns])


def held_out() -> "F.Column":
    """True for the rows that no model may learn from: crc32(doc_id as text) mod 4 is 2. A null id counts as not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Splits record batches so that each part has a bounded number of rows and, but for single rows, of bytes."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        start, size = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and (i - start >= SLICE_ROWS or size + n > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, text: str = "text") -> DataFrame:
    """mapInArrow of a function of one bounded slice."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield work(part)

    return df.mapInArrow(each, schema)


def add_by_slices(df: DataFrame, work: Callable[[pa.RecordBatch], list[pa.Array]], added: str, text: str = "text") -> DataFrame:
    """df with further columns, which a function gives for each bounded slice."""
    new = StructType.fromDDL(added)

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns, *work(part)], [*part.schema.names, *new.names])

    return map_slices(df, each, StructType(df.schema.fields + new.fields), text)
