"""What the operators share: their view of a table of documents, Arrow batches and staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from factlode.session import checkpoint_dir

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
SLICE_CHARS = 2_000_000
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def bound_batches(spark: SparkSession) -> None:
    """Whole texts make wide rows: the session sends Python at most BATCH_ROWS of them at once, or fewer if it says so already."""
    now = int(spark.conf.get(BATCH_SETTING, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def text_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *more: str) -> DataFrame:
    """Id and text alone: whatever else a table has can't clash with the columns an operator adds."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], chars: int = SLICE_CHARS) -> Iterator[dict[str, list]]:
    """Columns as lists, so many rows at a time that texts add up to about `chars` bytes (one row at least)."""
    for batch in batches:
        ends = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype("int64").cumsum()
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(ends.searchsorted(before + chars, side="right")))
            yield batch.slice(first, last - first).to_pydict()
            first = last


def map_slices(rows: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """Run make()'s function over slices of the rows; make() runs once in each task and may load tables."""
    target = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        work = make()
        for part in slices(batches):
            yield pa.RecordBatch.from_pydict(work(part), schema=arrow)

    return rows.mapInArrow(run, target)


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back: later jobs don't redo it when executors are lost."""
    spark = frame.sparkSession
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def remainder(column, modulus: int):
    """crc32 of an id written as text, modulo `modulus`; an id that is null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
