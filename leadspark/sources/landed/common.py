"""Expressions shared by the landed-data jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions.text import blank_to_null, column
from leadspark.sources.contracts import contract_schema


def text(value: Column | str) -> Column:
    return blank_to_null(value)


def number(value: Column | str) -> Column:
    """A plain number; anything else is NULL."""
    return column(value).try_cast("double")


def money(value: Column | str, signs: str = "$£") -> Column:
    """An amount such as '$1,199.00'."""
    return F.trim(F.regexp_replace(column(value).cast("string"), f"[{signs},]", "")).try_cast("double")


def day(value: Column | str) -> Column:
    """The date part of an ISO date or time."""
    return F.substring(column(value), 1, 10).try_cast("date")


def joined(*parts: Column | str, separator: str = " ") -> Column:
    """Non-empty parts joined; NULL when there are none."""
    return F.nullif(
        F.concat_ws(separator, *[F.nullif(column(part).cast("string"), F.lit("")) for part in parts]), F.lit("")
    )


def tail(value: Column | str) -> Column:
    """Last path segment."""
    return F.element_at(F.split(column(value), "/"), -1)


def bar_list(values: Column, *, repeats: bool = False) -> Column:
    """Non-empty items in first-seen order, joined by a bar; NULL when there are none."""
    kept = F.filter(values, lambda item: item.isNotNull() & (item != ""))
    kept = kept if repeats else F.array_distinct(kept)
    return F.nullif(F.array_join(kept, "|"), F.lit(""))


def items(value: Column | str, kind: str) -> Column:
    """The array, or one NULL item where it is missing or empty."""
    array = column(value)
    missing = array.isNull() | (F.size(array) == 0)
    return F.when(missing, F.array(F.lit(None).cast(kind))).otherwise(array)


def as_contract(df: DataFrame, table: str) -> DataFrame:
    """Contract columns in order and type; absent ones NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(field.name) if field.name in present else F.lit(None)).cast(field.dataType).alias(field.name)
            for field in contract_schema(table)
        ]
    )
