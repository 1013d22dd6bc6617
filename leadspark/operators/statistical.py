"""Detectors for any table: the caller maps columns to id, observed_at, amount and group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions import checks
from leadspark.functions.ordered import with_preceding_rows
from leadspark.functions.relational import one_row


def _row_id(prefix: str, value: str, missing: str) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(F.col(value).cast("string"), F.lit(missing))).alias("candidate_id")


def _labels(category: str) -> list[Column]:
    return [F.lit(category).alias("category"), F.lit("medium").alias("severity")]


def _with_flagged_count(flagged: DataFrame) -> DataFrame:
    """Number of flagged rows as a scalar subquery instead of a one-task window."""
    total = flagged.agg(F.count(F.lit(1)).alias("n")).scalar()
    return flagged.withColumn("observation_count", total)


def zscore_outliers(df: DataFrame, *, z_threshold: float = 3.0) -> DataFrame:
    """Rows far from the mean of all other rows (leave-one-out z-score).

    One aggregate over the amounts; the rows themselves are never shuffled.
    """
    checks.number("z_threshold", z_threshold, 0.5, 100.0)
    rows = df.select("id", F.col("amount").cast("double").alias("amount")).filter("amount IS NOT NULL")
    # One struct column, so the plan holds the subquery once per use of the struct and not per field.
    rows = rows.withColumn(
        "_all",
        one_row(
            rows.agg(
                F.avg("amount").alias("mean"),
                F.stddev_pop("amount").alias("sd"),
                F.count("amount").alias("n"),
                F.sum("amount").alias("total"),
                F.sum(F.col("amount") * F.col("amount")).alias("squares"),
            )
        ),
    )
    stats = F.col("_all")
    amount, others = F.col("amount"), stats["n"] - 1
    mean_of_others = F.try_divide(stats["total"] - amount, others)
    variance_of_others = F.try_divide(stats["squares"] - amount * amount, others) - F.pow(mean_of_others, F.lit(2.0))
    sd_of_others = F.sqrt(F.greatest(F.lit(0.0), variance_of_others))
    global_z = F.try_divide(F.abs(amount - stats["mean"]), stats["sd"])
    flagged = rows.select(
        _row_id("row-", "id", "unknown"),
        *_labels("outlier"),
        "amount",
        stats["mean"].alias("mean_amount"),
        stats["sd"].alias("stddev_amount"),
        global_z.alias("global_zscore"),
        F.when(stats["n"] > 2, F.try_divide(F.abs(amount - mean_of_others), sd_of_others))
        .otherwise(global_z)
        .alias("z_score"),
    ).filter(F.col("z_score") >= z_threshold)
    return _with_flagged_count(flagged)


def level_shift(df: DataFrame, *, window: int = 3, partitions: int | None = None) -> DataFrame:
    """Rows at least one overall standard deviation away from the mean of the rows before them."""
    checks.integer("window", window, 1, 1000)
    rows = df.select("id", "observed_at", F.col("amount").cast("double").alias("amount")).filter(
        "amount IS NOT NULL AND observed_at IS NOT NULL"
    )
    series = with_preceding_rows(
        rows,
        ["observed_at", "id", "amount"],
        window,
        {"previous_amount": F.last("amount"), "prior_window_mean": F.avg("amount")},
        partitions=partitions,
    )
    overall_sd = rows.agg(F.stddev_pop("amount").alias("sd")).scalar()
    flagged = series.select(
        _row_id("row-", "id", "unknown"),
        *_labels("distribution-shift"),
        "observed_at",
        "amount",
        "previous_amount",
        "prior_window_mean",
        (F.col("amount") - F.col("prior_window_mean")).alias("level_delta"),
        overall_sd.alias("overall_stddev"),
    ).filter(
        F.col("previous_amount").isNotNull()
        & (F.abs(F.col("level_delta")) >= F.coalesce(F.col("overall_stddev"), F.lit(0.0)))
    )
    return _with_flagged_count(flagged)


def coverage_gaps(df: DataFrame, *, maximum_gap_days: int = 1) -> DataFrame:
    """Pairs of consecutive observations more than ``maximum_gap_days`` day boundaries apart.

    Such a pair is always the last observation of one day and the first of the
    next observed day, so rows collapse to one per calendar day before ordering.
    """
    checks.integer("maximum_gap_days", maximum_gap_days, 1, 3650)
    per_day = (
        df.filter("observed_at IS NOT NULL")
        .groupBy(F.col("observed_at").cast("date").alias("day"))
        .agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))
    )
    by_day = Window.orderBy("day")  # one row per calendar day
    gaps = per_day.select(
        F.lag("last_seen").over(by_day).alias("previous_observed_at"),
        F.col("first_seen").alias("observed_at"),
        F.lag("day").over(by_day).alias("previous_day"),
        F.datediff("day", F.lag("day").over(by_day)).cast("long").alias("gap_days"),
    ).filter(F.col("gap_days") > maximum_gap_days)
    return _with_flagged_count(
        gaps.select(
            F.concat(F.lit("gap-"), F.col("previous_day").cast("string")).alias("candidate_id"),
            *_labels("coverage"),
            "previous_observed_at",
            "observed_at",
            "gap_days",
        )
    ).orderBy("previous_observed_at")


def rare_levels(df: DataFrame, *, maximum_fraction: float = 0.05) -> DataFrame:
    """Values of the group column that make up at most a given share of its non-null rows."""
    checks.number("maximum_fraction", maximum_fraction, 0.0, 1.0)
    rows = df.filter("group IS NOT NULL")
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    levels = rows.groupBy(F.col("group").alias("level_value")).agg(F.count(F.lit(1)).alias("level_count"))
    return (
        levels.select(
            F.concat(F.lit("level-"), F.col("level_value").cast("string")).alias("candidate_id"),
            *_labels("rarity"),
            "level_value",
            "level_count",
            total.alias("observation_count"),
        )
        .withColumn("level_fraction", F.col("level_count") / F.col("observation_count"))
        .filter(F.col("level_fraction") <= maximum_fraction)
        .orderBy("level_count", "candidate_id")
    )


def duplicate_rows(df: DataFrame, *, minimum_count: int = 2, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that occur at least ``minimum_count`` times.

    ``columns`` limits the comparison (``["id"]`` counts repeated ids); by
    default whole rows are compared.
    """
    checks.integer("minimum_count", minimum_count, 2, 1_000_000)
    compared = list(columns) if columns is not None else df.columns
    return (
        df.groupBy(*compared)
        .agg(F.count(F.lit(1)).alias("duplicate_count"))
        .filter(F.col("duplicate_count") >= minimum_count)
        .select(
            _row_id("row-", "id", "null"),
            *_labels("duplication"),
            "duplicate_count",
            F.col("duplicate_count").alias("observation_count"),
        )
        .orderBy(F.col("duplicate_count").desc(), "candidate_id")
    )


def missingness_clusters(df: DataFrame, *, min_missing_fraction: float = 0.2) -> DataFrame:
    """Groups whose rows without an amount make up a given share of the whole table."""
    checks.number("min_missing_fraction", min_missing_fraction, 0.0, 1.0)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    clusters = (
        df.filter("amount IS NULL AND group IS NOT NULL")
        .groupBy(F.col("group").alias("cluster_value"))
        .agg(F.count(F.lit(1)).alias("missing_count"))
    )
    return (
        clusters.select(
            F.concat(F.lit("row-group-"), F.col("cluster_value").cast("string")).alias("candidate_id"),
            *_labels("completeness"),
            "cluster_value",
            "missing_count",
            total.alias("observation_count"),
        )
        .withColumn("missing_fraction", F.col("missing_count") / F.col("observation_count"))
        .filter(F.col("missing_fraction") >= min_missing_fraction)
        .orderBy(F.col("missing_count").desc(), "candidate_id")
    )
