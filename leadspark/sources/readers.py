"""Strict readers for flat tables, and the union of heterogeneous records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SourceError(ValueError):
    """The source is not a flat table that can be read without loss."""


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON lines or Parquet by suffix, with inferred types."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if suffix in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    raise SourceError(f"no reader for {path}")


def _breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value may go on in the next line: a line then has an odd number of quotes."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).limit(1).isEmpty()


def read_csv(spark: SparkSession, path: str, *, multi_line: bool | None = None) -> DataFrame:
    """CSV as text columns; repeated header names and ragged rows are errors.

    Spark renames repeated headers silently, so the header line is read first.
    A row with another number of fields than the header fails the job. Files without
    line breaks inside quotes are split between tasks; the lines are looked through
    once to find out, unless ``multi_line`` says so (True: a file is one task; False is
    for files known to have no such breaks, whose parts would be read as rows).
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise SourceError("CSV has no header")
    # The header is parsed by the same CSV rules as the rows.
    parsed = spark.range(1).select(F.lit(first[0][0]).alias("line"))
    width = parsed.select(F.from_csv("line", F.schema_of_csv(F.lit(first[0][0]))).alias("h")).select("h.*")
    names = [value if value is None else str(value) for value in width.first()]
    if any(not name for name in names):
        raise SourceError("CSV header has an empty name")
    if len(set(names)) != len(names):
        raise SourceError("CSV header repeats a name")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("multiLine", _breaks_in_quotes(spark, path) if multi_line is None else multi_line)
        .option("escape", '"')
        .csv(path)
    )


def _json(spark: SparkSession, path: str, **options) -> DataFrame:
    reader = spark.read.option("mode", "FAILFAST").option("allowNonNumericNumbers", False)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One object or an array of objects per file; NaN and Infinity are errors."""
    return _json(spark, path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One object per line (LF or CRLF); blank lines are skipped. Splits large files."""
    return _json(spark, path, lineSep="\n")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet without nested columns."""
    df = spark.read.parquet(path)
    nested = [
        field.name for field in df.schema if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    ]
    if nested:
        raise SourceError(f"nested columns are not supported: {nested}")
    return df


def read_xml(spark: SparkSession, path: str, *, row_tag: str = "row") -> DataFrame:
    """Flat XML records; attributes and child elements both become columns."""
    return (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("attributePrefix", "")
        .option("mode", "FAILFAST")
        .option("inferSchema", False)
        .load(path)
    )


def union_records(*tables: DataFrame) -> DataFrame:
    """Rows of tables with different columns; first-seen column order, missing values NULL."""
    if not tables:
        raise SourceError("nothing to read")
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), tables)
