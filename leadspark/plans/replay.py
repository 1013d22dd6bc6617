"""Replay of leads, recomputation of their calculations, draft findings and report counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-12
# Kinds of calculation whose value can be compared between claims.
COMPARABLE_KINDS = ("percentage", "ratio", "relative_difference")


def recompute(calculations: DataFrame) -> DataFrame:
    """Check stated calculation values against their operands.

    Columns: kind, value, and the operands a kind needs (numerator, denominator,
    current, previous, value_input, mean, stddev, count, values). Adds
    ``expected``, ``ok`` and ``reason``.
    """
    def column(name: str, kind: str):
        return F.col(name).cast(kind) if name in calculations.columns else F.lit(None).cast(kind)

    def number(name: str):
        return column(name, "double")

    values = column("values", "array<double>")
    total = F.aggregate(values, F.lit(0.0), lambda running, item: running + item)
    kind = F.col("kind")
    by_division = kind.isin("ratio", "relative_difference", "percentage")
    by_difference = kind.isin("difference", "delta")
    by_values = kind.isin("sum", "mean")
    known = by_division | by_difference | by_values | kind.isin("zscore", "count")

    def unusable(*names: str):
        bad = F.lit(False)
        for name in names:
            bad = bad | ~F.coalesce(F.abs(number(name)) < float("inf"), F.lit(False)) | F.isnan(F.coalesce(number(name), F.lit(0.0)))
        return bad

    expected = (
        F.when(by_division, F.try_divide(number("numerator"), number("denominator")))
        .when(by_difference, number("current") - number("previous"))
        .when(kind == "zscore", F.try_divide(number("value_input") - number("mean"), number("stddev")))
        .when(kind == "count", number("count"))
        .when(kind == "sum", total)
        .when(kind == "mean", F.try_divide(total, F.size(values)))
    )
    bad_values = (
        values.isNull()
        | (F.size(values) < 1)
        | F.exists(values, lambda item: item.isNull() | F.isnan(item) | (F.abs(item) == float("inf")))
    )
    count = number("count")
    reason = (
        F.when(kind.isNull(), "calculation kind is required")
        .when(~known, F.concat(F.lit("unknown calculation kind: "), kind))
        .when(by_division & unusable("numerator", "denominator"), "invalid calculation operand")
        .when(by_division & (number("denominator") == 0), "calculation denominator is zero")
        .when(by_difference & unusable("current", "previous"), "invalid calculation operand")
        .when((kind == "zscore") & unusable("value_input", "mean", "stddev"), "invalid calculation operand")
        .when((kind == "zscore") & (number("stddev") == 0), "calculation standard deviation is zero")
        .when(
            (kind == "count") & (count.isNull() | (count < 0) | (count != F.floor(count))), "invalid count calculation"
        )
        .when(by_values & bad_values, "invalid aggregate calculation")
        .when(F.col("value").isNull(), "calculation value is missing")
        .when(unusable("value") | F.isnan(F.col("expected")) | (F.abs("expected") == float("inf")),
              "calculation value is non-finite")
        .when(F.abs(number("value") - F.col("expected")) > TOLERANCE, "calculation value does not match operands")
    )
    checked = calculations.withColumn("expected", expected).withColumn("reason", reason)
    return checked.withColumn("ok", F.col("reason").isNull())


def binding_errors(leads: DataFrame, runs: DataFrame, tables: DataFrame) -> DataFrame:
    """Leads that are not bound to a known run, to a table of it, or to that table's source.

    ``runs``: run_id, detector_id, detector_hash, table_id (a row per table).
    ``tables``: table_id, source_id, source_hash.
    """
    keys = ["signal_id", "run_id"]
    run_detectors = runs.select("run_id", "detector_id", "detector_hash").distinct()
    no_run = leads.join(run_detectors, ["run_id", "detector_id", "detector_hash"], "left_anti").select(
        *keys, F.lit("signal does not match its run").alias("reason")
    )
    no_table = leads.join(runs.select("run_id", "table_id").distinct(), ["run_id", "table_id"], "left_anti").select(
        *keys, F.lit("signal table is absent from its run").alias("reason")
    )
    no_source = leads.join(
        tables.select("table_id", "source_id", "source_hash").distinct(),
        ["table_id", "source_id", "source_hash"],
        "left_anti",
    ).select(*keys, F.lit("signal source does not match its table").alias("reason"))
    return no_run.unionByName(no_table).unionByName(no_source)


def replay(leads: DataFrame, runs: DataFrame, tables: DataFrame) -> DataFrame:
    """Per run: its leads, and how many of them are not bound to run, table and source.

    A run without leads counts 0.
    """
    errors = binding_errors(leads, runs, tables).select("signal_id", "run_id").distinct()
    unbound = errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("unbound_count"))
    counts = leads.groupBy("run_id").agg(F.count(F.lit(1)).alias("signal_count"))
    per_run = runs.groupBy("run_id", "detector_id", "detector_hash").agg(
        F.array_sort(F.collect_set("table_id")).alias("table_ids")
    )
    return (
        per_run.join(counts, "run_id", "left")
        .join(unbound, "run_id", "left")
        .select(
            "run_id",
            "detector_id",
            "detector_hash",
            "table_ids",
            F.coalesce("signal_count", F.lit(0)).alias("signal_count"),
            F.coalesce("unbound_count", F.lit(0)).alias("unbound_count"),
        )
    )


def differences(leads: DataFrame, rerun: DataFrame) -> DataFrame:
    """Leads that a second run no longer gives, and leads only it gives; repeats count."""
    shared = [name for name in leads.columns if name in rerun.columns and name not in ("executed_at", "provenance")]
    before, after = leads.select(*shared), rerun.select(*shared)
    return before.exceptAll(after).withColumn("change", F.lit("missing")).unionByName(
        after.exceptAll(before).withColumn("change", F.lit("added"))
    )


def draft_findings(leads: DataFrame) -> DataFrame:
    """Claims from leads: one per claim_id, or per signal when it has none.

    A claim takes statement, category and preview from its best ranked lead;
    ids, runs, categories and references are listed once each.
    """
    own_claim = F.regexp_replace("signal_id", "^signal-", "claim-")
    named = F.nullif(F.trim("claim_id"), F.lit("")) if "claim_id" in leads.columns else F.lit(None).cast("string")
    keyed = leads.withColumn("claim_id", F.coalesce(named, own_claim))
    best = F.struct("rank", "signal_id", "run_id")
    return (
        keyed.groupBy("claim_id")
        .agg(
            F.min("rank").alias("rank"),
            F.min_by("statement", best).alias("statement"),
            F.min_by("category", best).alias("category"),
            F.min_by("preview", best).alias("preview"),
            F.min_by("source_hash", best).alias("source_hash"),
            F.min_by("detector_hash", best).alias("detector_hash"),
            F.array_sort(F.collect_set("category")).alias("categories"),
            F.array_sort(F.collect_set("signal_id")).alias("signal_ids"),
            F.array_sort(F.collect_set("run_id")).alias("run_ids"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence_refs")))).alias("evidence_refs"),
        )
        .withColumn("status", F.lit("draft"))
        .orderBy("rank", "claim_id")
    )


def category_counts(claims: DataFrame) -> DataFrame:
    """Claims per category label; a claim counts once for each of its labels."""
    labels = F.array_distinct(F.concat(F.array("category"), F.coalesce("categories", F.array().cast("array<string>"))))
    return (
        claims.select(F.explode(labels).alias("label"))
        .filter("trim(label) <> ''")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("claims"))
        .orderBy("label")
    )


def comparable_values(claims: DataFrame) -> DataFrame:
    """Calculation values that can be compared between claims, best rank first.

    ``claims`` carries calculation_kind and calculation_value.
    """
    value = F.col("calculation_value").cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return (
        claims.filter(F.col("calculation_kind").isin(*COMPARABLE_KINDS) & finite)
        .select("claim_id", value.alias("value"), F.coalesce(F.col("rank"), F.lit(10**9)).alias("rank"))
        .orderBy("rank", "claim_id")
    )


def detector_counts(runs: DataFrame) -> DataFrame:
    """Leads per detector over all runs."""
    return (
        runs.filter("trim(detector_id) <> '' AND signal_count >= 0")
        .groupBy("detector_id")
        .agg(F.sum("signal_count").alias("signals"))
        .orderBy("detector_id")
    )
