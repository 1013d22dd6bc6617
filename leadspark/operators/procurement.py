"""Public procurement detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions import checks
from leadspark.functions.relational import in_order, one_row, top, with_joined_list
from leadspark.functions.text import decimal_round
from leadspark.session import cut_lineage

COMPETITIVE_METHODS = ("open", "selective")
NON_OPEN_METHODS = ("limited", "direct")


def single_bid_competitive(procurement_processes: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Competitive processes with exactly one bid."""
    checks.row_limit(limit)
    return top(
        procurement_processes.filter(
            (F.col("number_of_tenderers") == 1) & F.lower("procurement_method").isin(*COMPETITIVE_METHODS)
        )
        .groupBy("process_id")
        .agg(
            F.min("buyer_id").alias("buyer_id"),
            F.min("buyer_name").alias("buyer_name"),
            F.min("category_code").alias("category_code"),
            F.min("procurement_method").alias("procurement_method"),
            F.max("number_of_tenderers").alias("number_of_tenderers"),
            F.max("tender_value").alias("tender_value"),
            F.min("currency").alias("currency"),
        ),
        [F.col("tender_value").desc_nulls_last(), F.col("process_id").asc_nulls_last()],
        limit,
    )


def short_submission_period(
    procurement_processes: DataFrame, *, min_days: int = 10, limit: int | None = None
) -> DataFrame:
    """Competitive processes (or of unknown method) that gave bidders only a few days."""
    checks.integer("min_days", min_days, 1, 365)
    checks.row_limit(limit)
    method = F.col("procurement_method")
    per_process = (
        procurement_processes.filter(
            F.col("tender_published_date").isNotNull()
            & F.col("tender_deadline").isNotNull()
            & (method.isNull() | F.lower(method).isin(*COMPETITIVE_METHODS))
        )
        .groupBy("process_id")
        .agg(
            F.min("buyer_id").alias("buyer_id"),
            F.min("buyer_name").alias("buyer_name"),
            F.min("procurement_method").alias("procurement_method"),
            F.min("tender_published_date").alias("tender_published_date"),
            F.max("tender_deadline").alias("tender_deadline"),
            F.max("tender_value").alias("tender_value"),
            F.min("currency").alias("currency"),
        )
        .withColumn("submission_days", F.datediff("tender_deadline", "tender_published_date").cast("long"))
    )
    return top(
        per_process.filter((F.col("submission_days") >= 0) & (F.col("submission_days") < min_days)).select(
            "process_id",
            "buyer_id",
            "buyer_name",
            "procurement_method",
            "tender_published_date",
            "tender_deadline",
            "submission_days",
            "tender_value",
            "currency",
        ),
        [F.col("submission_days"), F.col("process_id").asc_nulls_last()],
        limit,
    )


def non_open_procedure_share(
    procurement_processes: DataFrame, *, min_processes: int = 5, min_share: float = 0.3, limit: int | None = None
) -> DataFrame:
    """Buyers with a high share of limited or direct procedures, next to the IQR fence of all buyers."""
    checks.integer("min_processes", min_processes, 1, 100_000)
    checks.number("min_share", min_share, 0, 1)
    checks.row_limit(limit)
    method = F.lower("procurement_method")
    # One row per buyer and process first, so the counts need no DISTINCT and a hot buyer is spread.
    per_process = procurement_processes.groupBy("buyer_id", "process_id").agg(
        F.min("buyer_name").alias("buyer_name"),
        F.max(method.isNotNull()).alias("known"),
        F.max(method.isNull()).alias("unknown"),
        F.max(F.coalesce(method.isin(*NON_OPEN_METHODS), F.lit(False))).alias("non_open"),
    )
    counted = F.col("process_id").isNotNull()
    buyers = (
        per_process.groupBy("buyer_id")
        .agg(
            F.min("buyer_name").alias("buyer_name"),
            F.count_if(counted & F.col("known")).alias("processes"),
            F.count_if(counted & F.col("unknown")).alias("unknown_method_processes"),
            F.count_if(counted & F.col("non_open")).alias("non_open_processes"),
        )
        .filter(F.col("processes") >= min_processes)
        .withColumn("share", F.col("non_open_processes") / F.col("processes"))
    )
    # Equal shares collapse before the exact percentile sees them.
    shares = buyers.groupBy("share").agg(F.count(F.lit(1)).alias("buyers"))
    quartiles = one_row(
        shares.agg(F.percentile("share", F.array(F.lit(0.25), F.lit(0.75)), F.col("buyers")).alias("q"))
    )["q"]
    fence = quartiles[1] + 1.5 * (quartiles[1] - quartiles[0])
    ranked = top(
        buyers.filter(F.col("share") >= min_share),
        [F.col("share").desc(), F.col("processes").desc(), F.col("buyer_id").asc_nulls_last()],
        limit,
    )
    return ranked.select(
        "buyer_id",
        "buyer_name",
        "processes",
        "unknown_method_processes",
        "non_open_processes",
        decimal_round("share", 4).alias("non_open_share"),
        decimal_round(fence, 4).alias("iqr_upper_fence"),
        (F.col("share") >= fence).alias("above_iqr_fence"),
    )


def supplier_share_outlier(
    procurement_processes: DataFrame,
    procurement_awards: DataFrame,
    *,
    min_awards: int = 5,
    min_share: float = 0.4,
    limit: int | None = None,
) -> DataFrame:
    """Suppliers that win a high share of one buyer's award value in a year and market."""
    checks.integer("min_awards", min_awards, 1, 100_000)
    checks.number("min_share", min_share, 0, 1)
    checks.row_limit(limit)
    awards = (
        procurement_awards.filter("award_value > 0 AND award_date IS NOT NULL")
        .select("award_id", "process_id", "supplier_id", "supplier_name", "award_value", "currency", "award_date")
        .distinct()
    )
    processes = procurement_processes.groupBy("process_id").agg(
        F.min(F.coalesce("buyer_id", "buyer_name")).alias("buyer_key"),
        F.min("buyer_name").alias("buyer_name"),
        F.coalesce(F.min("category_code"), F.lit("")).alias("category_key"),
        F.min("currency").alias("process_currency"),
    )
    placed = awards.join(processes, "process_id")
    # A count and a join rather than a window: one award may hold very many rows.
    shares = placed.groupBy("award_id").agg(F.count(F.lit(1)).alias("award_rows"))
    valued = placed.join(
        shares.withColumnRenamed("award_id", "_award"), F.col("award_id").eqNullSafe(F.col("_award"))
    ).select(
        "award_id",
        "supplier_id",
        "supplier_name",
        (F.col("award_value") / F.col("award_rows")).alias("value"),
        F.coalesce("currency", "process_currency", F.lit("")).alias("currency_key"),
        F.year("award_date").cast("long").alias("award_year"),
        "buyer_key",
        "buyer_name",
        "category_key",
    )
    market = ["buyer_key", "category_key", "award_year", "currency_key"]
    # One shuffle of the rows, by market and award; markets are sums of the suppliers' rows. An award is counted with the
    # first of its suppliers in a market, so no distinct count multiplies the rows.
    per_award = (
        valued.filter("buyer_key IS NOT NULL")
        .repartition(*market, "award_id")
        .groupBy(*market, "supplier_id", "award_id")
        .agg(
            F.sum("value").alias("value"),
            F.min("supplier_name").alias("supplier_name"),
            F.min("buyer_name").alias("buyer_name"),
        )
    )
    nth = F.row_number().over(Window.partitionBy(*market, "award_id").orderBy("supplier_id"))
    first = (nth == 1) & F.col("award_id").isNotNull()
    suppliers = cut_lineage(
        per_award.withColumn("_first", first)
        .groupBy(*market, "supplier_id")
        .agg(
            F.min("supplier_name").alias("supplier_name"),
            F.min("buyer_name").alias("buyer_name"),
            F.sum("value").alias("supplier_value"),
            F.count("award_id").alias("supplier_awards"),
            F.count_if("_first").alias("_awards"),
        )
    )
    markets = (
        suppliers.groupBy(*market)
        .agg(
            F.sum("supplier_value").alias("market_value"),
            F.sum("_awards").alias("market_awards"),
            F.count("supplier_id").alias("market_suppliers"),
        )
        .filter(F.col("market_awards") >= min_awards)
    )
    share = F.col("supplier_value") / F.col("market_value")
    return top(
        suppliers.join(markets, market)
        .filter(share > min_share)
        .select(
            "supplier_id",
            "supplier_name",
            F.col("buyer_key").alias("buyer_id"),
            "buyer_name",
            F.nullif("category_key", F.lit("")).alias("category_code"),
            "award_year",
            F.nullif("currency_key", F.lit("")).alias("currency"),
            "supplier_value",
            "market_value",
            decimal_round(share, 4).alias("supplier_share"),
            "supplier_awards",
            "market_awards",
            "market_suppliers",
        ),
        [
            F.col("supplier_share").desc(),
            F.col("supplier_value").desc(),
            F.col("supplier_id").asc_nulls_last(),
            F.col("buyer_id"),
            F.col("category_code").asc_nulls_last(),
            F.col("award_year"),
            F.col("currency").asc_nulls_last(),
        ],
        limit,
    )


def value_growth_after_award(
    procurement_processes: DataFrame,
    procurement_awards: DataFrame,
    *,
    min_growth: float = 0.2,
    min_increase: float = 0,
    limit: int | None = None,
) -> DataFrame:
    """Awards whose final value exceeds the awarded value by a ratio and an amount."""
    checks.number("min_growth", min_growth, 0, 1000)
    checks.number("min_increase", min_increase, 0, 1_000_000_000_000)
    checks.row_limit(limit)
    growth = F.col("final_value") - F.col("award_value")
    grown = (
        procurement_awards.groupBy("award_id")
        .agg(
            F.min("process_id").alias("process_id"),
            F.min("award_value").alias("award_value"),
            F.max("final_value").alias("final_value"),
            F.min("currency").alias("currency"),
            F.min("award_date").alias("award_date"),
        )
        .filter(
            (F.col("award_value") > 0)
            & (F.col("final_value") > F.col("award_value") * (1 + float(min_growth)))
            & (growth >= min_increase)
        )
    )
    order = [F.col("value_increase").desc(), F.col("award_id").asc_nulls_last()]
    leads = top(
        grown.select(
            "award_id",
            "process_id",
            "award_value",
            "final_value",
            growth.alias("value_increase"),
            decimal_round(F.col("final_value") / F.col("award_value"), 4).alias("growth_ratio"),
            "currency",
            "award_date",
        ),
        order,
        limit,
    )
    buyers = procurement_processes.groupBy("process_id").agg(
        F.min("buyer_id").alias("buyer_id"), F.min("buyer_name").alias("buyer_name")
    )
    distinct_rows = procurement_awards.select(
        "award_id", "process_id", "supplier_name", "award_value", "final_value", "currency", "award_date"
    ).distinct()
    leads = with_joined_list(
        leads.join(buyers, "process_id", "left"),
        distinct_rows,
        ["award_id"],
        "supplier_name",
        "suppliers",
        distinct=False,
    )
    return leads.select(
        "award_id",
        "process_id",
        "buyer_id",
        "buyer_name",
        "suppliers",
        "award_value",
        "final_value",
        "value_increase",
        "growth_ratio",
        "currency",
        "award_date",
    ).transform(in_order(order, limit))
