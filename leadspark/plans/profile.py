"""Profiles of prepared tables: field metrics, distributions, duplicates and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Prepared type of a Spark type.
TYPE_NAMES = {
    "bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer",
    "double": "float", "float": "float",
    "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "datetime",
}


def prepared_type(kind: str) -> str:
    return TYPE_NAMES.get(kind, "text")


def _unpivoted(df: DataFrame) -> DataFrame:
    """(field, value) rows with the value as text."""
    fields = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.col(f"`{name}`").cast("string").alias("value"))
            for name in df.columns
        ]
    )
    return df.select(F.explode(fields).alias("_f")).select("_f.field", "_f.value")


def field_metrics(df: DataFrame, *, table_id: str = "table") -> DataFrame:
    """One row per field: type, missing count and share, exact cardinality, and range.

    Counts and ranges come from one scan of partial aggregates. Cardinality
    counts distinct (field, value) pairs, so the shuffle carries each value of a
    field once per task, whatever the number of fields.
    """
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, (name, kind) in enumerate(df.dtypes):
        value = F.col(f"`{name}`")
        aggregates.append(F.count(value).alias(f"_n{i}"))
        if prepared_type(kind) != "text":
            aggregates += [F.min(value).alias(f"_lo{i}"), F.max(value).alias(f"_hi{i}")]
    counted = df.agg(*aggregates)
    rows = F.col("_rows")
    described = []
    for i, (name, kind) in enumerate(df.dtypes):
        has_range = prepared_type(kind) != "text"
        described.append(
            F.struct(
                F.lit(name).alias("field"),
                F.lit(prepared_type(kind)).alias("type"),
                rows.alias("row_count"),
                (rows - F.col(f"_n{i}")).alias("missing_count"),
                F.coalesce(F.try_divide(rows - F.col(f"_n{i}"), rows), F.lit(0.0)).alias("missing_fraction"),
                (F.col(f"_lo{i}").cast("string") if has_range else F.lit(None).cast("string")).alias("min_value"),
                (F.col(f"_hi{i}").cast("string") if has_range else F.lit(None).cast("string")).alias("max_value"),
            )
        )
    metrics = counted.select(F.explode(F.array(*described)).alias("_m")).select("_m.*")
    cardinality = (
        _unpivoted(df)
        .filter("value IS NOT NULL")
        .distinct()
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("cardinality"))
    )
    return metrics.join(cardinality, "field", "left").select(
        F.lit(table_id).alias("table_id"),
        "field",
        "type",
        "row_count",
        "missing_count",
        "missing_fraction",
        F.coalesce("cardinality", F.lit(0)).alias("cardinality"),
        "min_value",
        "max_value",
    )


def value_distribution(df: DataFrame) -> DataFrame:
    """Every value of every field with its count, most frequent first."""
    return (
        _unpivoted(df)
        .filter("value IS NOT NULL")
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("field", F.col("count").desc(), "value")
    )


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def temporal_coverage(df: DataFrame, field: str) -> DataFrame:
    """First and last instant of a time column; no row when it holds none."""
    value = F.col(f"`{field}`").cast("timestamp")
    return df.agg(F.min(value).alias("start"), F.max(value).alias("end")).filter("start IS NOT NULL").select(
        F.lit(field).alias("field"), "start", "end"
    )


def geographic_coverage(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    """Bounds over the rows that have both coordinates; no row when there are none."""
    lat, lon = F.col(f"`{latitude}`").cast("double"), F.col(f"`{longitude}`").cast("double")
    return (
        df.filter(lat.isNotNull() & lon.isNotNull())
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min(lat).alias("min_latitude"),
            F.max(lat).alias("max_latitude"),
            F.min(lon).alias("min_longitude"),
            F.max(lon).alias("max_longitude"),
        )
        .filter("row_count > 0")
    )


def copy_differences(original: DataFrame, copy: DataFrame) -> DataFrame:
    """Rows in which two copies of a table differ; repeats count. A schema difference is an error."""
    if original.dtypes != copy.dtypes:
        raise ValueError(f"schemas differ: {original.dtypes} and {copy.dtypes}")
    return (
        original.exceptAll(copy)
        .withColumn("change", F.lit("missing"))
        .unionByName(copy.exceptAll(original).withColumn("change", F.lit("added")))
    )
