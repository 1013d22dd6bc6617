"""Helpers of the corpus operators: reading, task loops over texts, lineage cuts."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Functions of this subpackage travel to the executors with their code: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules["leadspark.llm"])

# A batch is cut so that its texts stay under this many bytes (one longer text is a batch alone).
BATCH_BYTES = 8_000_000

# Words of the corpus contracts: everything between ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose values in ``column`` hold at most BATCH_BYTES."""
    values = batch.column(column)
    start = size = 0
    for row in range(batch.num_rows):
        held = values[row].as_buffer()
        more = held.size if held is not None else 0
        if row > start and size + more > BATCH_BYTES:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += more
    if batch.num_rows > start:
        yield batch.slice(start)


def map_texts(
    docs: DataFrame,
    output: list[tuple[str, str]],
    work: Callable[[], Callable[[list[str | None]], list]],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One output row per row of ``docs``: its id and the columns that ``work`` makes of its text.

    ``work`` is called once in each task and returns a function from a list of
    texts to one list (or array) per output column. Rows stay where they are:
    no shuffle, and no state outside a task.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, kind)] + [T.StructField(name, T._parse_datatype_string(type_)) for name, type_ in output]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        of_texts = work()
        for batch in batches:
            for part in cut(batch, 1):
                made = of_texts(part.column(1).to_pylist())
                columns = [part.column(0).cast(arrow.field(0).type)]
                columns += [pa.array(values, arrow.field(i).type) for i, values in enumerate(made, 1)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
