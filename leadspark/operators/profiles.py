"""Detectors over what records say about one id (own definitions of draft detectors)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions import checks


def plain_value(value: Column) -> Column:
    """A value as text in lower case with single blanks; NULL if nothing is left."""
    text = F.trim(F.regexp_replace(F.lower(value.cast("string")), r"\s+", " "))
    return F.nullif(text, F.lit(""))


def conflicting_profiles(
    df: DataFrame, *, attributes: Sequence[str] | None = None, minimum_minority: int = 1, id_col: str = "id"
) -> DataFrame:
    """Ids whose records disagree about an attribute.

    ``attributes`` are columns (all but the id by default), compared as plain values;
    missing values disagree with nothing. A row per id and attribute with the most frequent
    value (of several the smallest), how many records support it, and how many say
    otherwise. Records are counted by value first, so an id with very many records
    sends one row per value and task, and only counts are brought together.
    """
    checks.at_least("minimum_minority", minimum_minority, 1)
    names = list(attributes) if attributes is not None else [name for name in df.columns if name != id_col]
    if not names or len(set(names)) != len(names) or not set(names) <= set(df.columns) - {id_col}:
        raise checks.ParameterError("attributes must name columns of the table other than the id, each once")
    stated = F.array(*[F.struct(F.lit(name).alias("attribute"), plain_value(F.col(f"`{name}`")).alias("value")) for name in names])
    said = df.select(F.col(id_col).alias("id"), F.explode(stated).alias("_s")).filter("id IS NOT NULL AND _s.value IS NOT NULL")
    values = said.groupBy("id", "_s.attribute", "_s.value").agg(F.count("*").alias("n"))
    found = values.groupBy("id", "attribute").agg(
        F.count("*").alias("distinct_values"),
        F.sum("n").alias("records"),
        F.min(F.struct((-F.col("n")).alias("rank"), "value")).alias("_first"),
    )
    support = -F.col("_first.rank")
    return found.filter((F.col("distinct_values") > 1) & (F.col("records") - support >= minimum_minority)).select(
        F.concat(F.lit("profile-"), F.col("id").cast("string"), F.lit("-"), F.col("attribute")).alias("candidate_id"),
        F.lit("conflict").alias("category"),
        F.lit("medium").alias("severity"),
        F.col("id").alias("entity_id"),
        "attribute",
        "distinct_values",
        F.col("_first.value").alias("majority_value"),
        support.alias("support"),
        (F.col("records") - support).alias("contradicting"),
        (support / F.col("records")).alias("support_share"),
    )
