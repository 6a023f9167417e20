"""What the operators of this subpackage share: reading, materialising, and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: No slice of an Arrow batch handed to Python code holds more bytes of text than this, but for a single longer text.
SLICE_BYTES = 4 << 20
#: Rows in an Arrow batch between the JVM and Python.
BATCH_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, one of our own, in local sessions only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
        current = context.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared folder; a lost executor loses nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus. Null ids give null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (it is counted), else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without a decoding step."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about SLICE_BYTES of text at most; whole texts always stay together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = [0 if n is None else n for n in pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()]
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text: str = "text") -> DataFrame:
    """Apply make()'s function to slices of df. make runs once a task, so that what it loads is loaded there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for piece in slices(batches, text):
            yield step(piece)

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(run, schema)
