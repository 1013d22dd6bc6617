"""The registered queries: every operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.operators import statistical
from leadspark.plans.registry import RELEASED, detector
from leadspark.testbed.bindings import bind

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def four_places(value: Column) -> Column:
    """The small shift keeps exact halves (means of cents) off the rounding boundary."""
    return F.round(value + 0.0000003, 4)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to four places: sums of doubles depend on the order of the rows."""
    return df.select(
        *[four_places(F.col(name)).alias(name) if kind == "double" else F.col(name) for name, kind in df.dtypes]
    )


# Parameters that differ from the defaults, because the test data is thin.
PARAMETERS = {
    "parliamentary.rebellion_rise": {"min_votes_per_period": 8},
}


def _domain_query(id: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = detector(id)
        return rounded(chosen.run(*bind(spark, sf_dir, *chosen.tables), **PARAMETERS.get(id, {})))

    return query


def _gifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = detector("court.gift_from_litigant_or_counsel")
    # Its only doubles are values of gifts, and a gift has very many leads: rounded as gifts, not as leads.
    return chosen.run(*bind(spark, sf_dir, *chosen.tables), amounts=four_places)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("observed_at"), F.col("value").alias("amount")
    )


def _zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistical.zscore_outliers(_events(spark, sf_dir)))


def _level_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistical.level_shift(_events(spark, sf_dir)))


def _coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return statistical.coverage_gaps(
        orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("observed_at"))
    )


def _rare_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return rounded(statistical.rare_levels(documents.select(F.concat_ws("/", "source", "lang").alias("group"))))


def _duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return statistical.duplicate_rows(
        lines.select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_returnflag")
    )


def _duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return statistical.duplicate_rows(lines.select(F.col("l_orderkey").alias("id")), minimum_count=9)


def _missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    amount = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.col("o_totalprice"))
    return rounded(
        statistical.missingness_clusters(
            orders.select(F.col("o_orderstatus").alias("group"), amount.alias("amount"))
        )
    )


def detector_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "numeric.zscore_outliers": _zscore,
        "numeric.level_shift": _level_shift,
        "temporal.coverage_gaps": _coverage_gaps,
        "categorical.rare_levels": _rare_levels,
        "table.duplicate_rows": _duplicate_rows,
        "table.duplicate_ids": _duplicate_ids,
        "table.missingness_clusters": _missingness,
    }
    for released in RELEASED:
        if released.tables:
            found[released.id] = _domain_query(released.id)
    found["court.gift_from_litigant_or_counsel"] = _gifts
    return found
