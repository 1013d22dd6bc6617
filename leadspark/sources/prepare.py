"""Preparation of a flat table: clean text, redaction, and lossless column types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.functions.text import blank_to_null, redact_text

# Texts of a prepared integer, float and instant.
INTEGER_TEXT = r"^[+-]?(?:0|[1-9][0-9]*)$"
FLOAT_TEXT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
INSTANT_TEXT = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,6})?)?(?:Z|[+-][0-9]{2}:[0-9]{2})?)?$"
)
PREPARED_TYPES = {"integer": "bigint", "float": "double", "datetime": "timestamp", "text": "string"}

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def clean_values(df: DataFrame) -> DataFrame:
    """Strip text, empty text to NULL, nested values to JSON text."""
    columns = []
    for field in df.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            value = blank_to_null(value)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(value)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def redact_text_columns(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            (redact_text(f"`{name}`") if kind == "string" else F.col(f"`{name}`")).alias(name)
            for name, kind in df.dtypes
        ]
    )


def _as_float(text: Column) -> Column:
    value = F.when(text.rlike(FLOAT_TEXT), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def _as_instant(text: Column) -> Column:
    """ISO date or time as an instant; without a zone it is UTC, whatever the zone of the session."""
    # A cast to an instant reads a zone only after seconds.
    full = F.regexp_replace(text, r"([T ][0-9]{2}:[0-9]{2})(Z|[+-][0-9]{2}:[0-9]{2})?$", "$1:00$2")
    zoned = (
        F.when(~text.contains(":"), F.concat(text, F.lit("T00:00:00Z")))
        .when(full.rlike(r"[T ][0-9:.]+$"), F.concat(full, F.lit("Z")))
        .otherwise(full)
    )
    return F.when(text.rlike(INSTANT_TEXT), zoned.try_cast("timestamp"))


def infer_types(df: DataFrame) -> dict[str, str]:
    """Narrowest prepared type that holds every value of each column.

    Integer, else float, else instant, else text; a column without values is
    text, and so are booleans. One aggregation over all columns; the result is
    one row.
    """
    checks, fixed = [], {}
    for i, field in enumerate(df.schema):
        value = F.col(f"`{field.name}`")
        checks.append(F.count(value).alias(f"n{i}"))
        if isinstance(field.dataType, _NUMBERS):
            fixed[i] = "integer"
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            number = value.cast("double")
            checks.append(F.bool_and(number == F.floor(number)).alias(f"i{i}"))
            checks.append(F.bool_and(F.abs(number) < float("inf")).alias(f"f{i}"))
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            fixed[i] = "datetime"
        elif isinstance(field.dataType, T.StringType):
            # A text is an integer only if it fits the prepared integer type.
            whole = F.when(value.rlike(INTEGER_TEXT), value.try_cast("bigint")).isNotNull()
            checks.append(F.bool_and(F.when(value.isNotNull(), whole)).alias(f"i{i}"))
            checks.append(F.bool_and(F.when(value.isNotNull(), _as_float(value).isNotNull())).alias(f"f{i}"))
            checks.append(F.bool_and(F.when(value.isNotNull(), _as_instant(value).isNotNull())).alias(f"d{i}"))
        else:
            fixed[i] = "text"
    result = df.agg(*checks).first().asDict()
    types = {}
    for i, field in enumerate(df.schema):
        if result[f"n{i}"] == 0:
            types[field.name] = "text"
        elif i in fixed:
            types[field.name] = fixed[i]
        elif result.get(f"i{i}"):
            types[field.name] = "integer"
        elif result.get(f"f{i}"):
            types[field.name] = "float"
        elif result.get(f"d{i}"):
            types[field.name] = "datetime"
        else:
            types[field.name] = "text"
    return types


def convert_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast every column to its prepared type."""
    columns = []
    for name, kind in df.dtypes:
        value, wanted = F.col(f"`{name}`"), types[name]
        if kind == "string" and wanted == "float":
            value = _as_float(value)
        elif kind == "string" and wanted == "datetime":
            value = _as_instant(value)
        elif kind == "timestamp_ntz" and wanted == "datetime":
            value = F.convert_timezone(F.lit("UTC"), F.current_timezone(), value).cast("timestamp")
        columns.append(value.cast(PREPARED_TYPES[wanted]).alias(name))
    return df.select(*columns)


def prepare(df: DataFrame) -> DataFrame:
    """Clean, redact, infer and convert."""
    cleaned = clean_values(redact_text_columns(df))
    return convert_types(cleaned, infer_types(cleaned))
