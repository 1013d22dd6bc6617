"""Which detectors fit which profiled tables, and in which order to run them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions import checks
from leadspark.plans.registry import Detector

COVERAGE_TOLERANCE = 1e-12


def requirement_rows(spark, detectors: Mapping[str, Detector]) -> tuple[DataFrame, DataFrame]:
    """Detectors with their scores, and the fields they need (one row per detector and field).

    Detectors over contract tables need no single field, only their tables.
    """
    scored = spark.createDataFrame(
        [
            (
                item.id,
                item.group,
                list(item.tables),
                len(item.roles),
                float(item.relevance),
                float(item.utility),
                float(item.cost),
                float(item.false_positive_risk),
            )
            for item in detectors.values()
        ],
        "detector_id string, detector_group string, tables array<string>, field_count int, relevance double, "
        "utility double, cost double, false_positive_risk double",
    )
    fields = spark.createDataFrame(
        [
            (item.id, role, list(item.types.get(role, ())), float(item.minimum_coverage.get(role, 0.0)))
            for item in detectors.values()
            for role in item.roles
        ],
        "detector_id string, field string, types array<string>, minimum_coverage double",
    )
    return scored, fields


def match_detectors(profile: DataFrame, detectors: DataFrame, requirements: DataFrame) -> DataFrame:
    """One row per detector: its fit over compatible tables, or why it is blocked.

    ``profile`` has table_id, table_name, field, type and missing_fraction, for
    any number of tables. A table is compatible when every required field is
    there, has an accepted type and enough coverage; its fit is the mean
    coverage of these fields. Requirements are the registry's, a small fixed
    table, and profile rows meet them by equality on the field name.
    """
    satisfied = (
        profile.join(requirements, "field")
        .withColumn("coverage", 1.0 - F.coalesce("missing_fraction", F.lit(0.0)))
        .filter(
            ((F.size("types") == 0) | F.array_contains("types", F.col("type")))
            & (F.col("coverage") + COVERAGE_TOLERANCE >= F.col("minimum_coverage"))
        )
        .groupBy("detector_id", "table_id", "table_name")
        .agg(F.count_distinct("field").alias("fields_met"), F.avg("coverage").alias("fit"))
    )
    fixed = detectors
    by_fields = (
        satisfied.join(fixed.filter("field_count > 0"), "detector_id")
        .filter("fields_met = field_count")
        .filter((F.size("tables") == 0) | F.array_contains("tables", F.col("table_name")))
        .select("detector_id", "table_id", "fit")
    )
    by_table = (
        profile.select("table_id", "table_name")
        .distinct()
        .join(
            fixed.filter("field_count = 0").select("detector_id", F.explode("tables").alias("table_name")),
            "table_name",
        )
        .select("detector_id", "table_id", F.lit(1.0).alias("fit"))
    )
    compatible = (
        by_fields.unionByName(by_table)
        .groupBy("detector_id")
        .agg(F.max("fit").alias("data_fit"), F.count_distinct("table_id").alias("compatible_tables"))
    )
    reason = F.when(
        F.col("data_fit").isNull(),
        F.when(F.col("field_count") > 0, "incompatible with profile (required field, required type, coverage)")
        .otherwise("incompatible with profile (required table)"),
    )
    return detectors.join(compatible, "detector_id", "left").withColumn("blocked_reason", reason)


def recommend(matches: DataFrame, *, max_detectors: int | None = None) -> DataFrame:
    """The best detector of every group first, then the rest by score; ``max_detectors`` keeps the first ones."""
    if max_detectors is not None:
        checks.at_least("max_detectors", max_detectors, 1)
    scored = matches.filter("blocked_reason IS NULL").withColumn(
        "score",
        F.col("relevance") + F.col("data_fit") + F.col("utility") - F.col("cost") - F.col("false_positive_risk"),
    )
    order = [
        F.col("score").desc(),
        F.col("relevance").desc(),
        F.col("data_fit").desc(),
        F.col("utility").desc(),
        F.col("cost"),
        F.col("false_positive_risk"),
        F.col("detector_id"),
    ]
    in_group = Window.partitionBy("detector_group").orderBy(*order)
    placed = scored.withColumn("rank_in_group", F.row_number().over(in_group))
    later = F.col("rank_in_group") > 1
    ordered = placed.orderBy(later, *order)
    return ordered if max_detectors is None else ordered.limit(max_detectors)
