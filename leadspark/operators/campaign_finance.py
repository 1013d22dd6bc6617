"""Campaign finance detectors over donations and recipients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions import checks
from leadspark.functions.ordered import day_number, distinct_in_forward_window
from leadspark.functions.relational import first_per_key, in_order, top, with_joined_list
from leadspark.functions.text import EMPLOYER_STOP_WORDS, blank_to_null, decimal_round, postcode_key, upper_trim


def maxed_donor_clusters(
    donations: DataFrame,
    *,
    limit_amount: float = 3500,
    near_limit_ratio: float = 0.9,
    window_days: int = 7,
    min_donors: int = 3,
    limit: int | None = None,
) -> DataFrame:
    """Several donors with one employer or postcode who each give near the limit within a few days."""
    checks.number("limit_amount", limit_amount, 1, 100_000_000)
    checks.number("near_limit_ratio", near_limit_ratio, 0.1, 1)
    checks.integer("window_days", window_days, 0, 366)
    checks.integer("min_donors", min_donors, 2, 1000)
    checks.row_limit(limit)

    near_limit = donations.filter(
        (F.col("amount") >= float(limit_amount) * float(near_limit_ratio)) & F.col("donation_date").isNotNull()
    )
    employer = upper_trim("donor_employer")
    shared = F.explode(
        F.filter(
            F.array(
                F.struct(
                    F.lit("employer").alias("by"),
                    F.when(~employer.isin(*EMPLOYER_STOP_WORDS) & (employer != ""), employer).alias("value"),
                ),
                F.struct(
                    F.lit("postcode").alias("by"),
                    F.when(blank_to_null("donor_postcode").isNotNull(), postcode_key("donor_postcode")).alias("value"),
                ),
            ),
            lambda item: item["value"].isNotNull(),
        )
    )
    gifts = near_limit.select(
        "recipient_id", "recipient_name", "donor_name", "amount", "donation_date", shared.alias("shared")
    ).select(
        "recipient_id",
        "recipient_name",
        F.col("shared.by").alias("shared_by"),
        F.col("shared.value").alias("shared_value"),
        upper_trim("donor_name").alias("donor_key"),
        "donor_name",
        "amount",
        day_number("donation_date").alias("day"),
    )
    # Equality on recipient_id never holds for NULL, so such gifts form no window.
    gifts = gifts.filter("recipient_id IS NOT NULL")

    keys = ["recipient_id", "shared_by", "shared_value"]
    daily = gifts.groupBy(*keys, "day").agg(
        F.count(F.lit(1)).alias("gifts"),
        F.sum("amount").alias("amount"),
        F.min("recipient_name").alias("recipient_name"),
    )
    donors = distinct_in_forward_window(gifts, keys, "day", "donor_key", window_days)
    days = daily.join(donors, [*keys, "day"])
    ahead = Window.partitionBy(*keys).orderBy("day").rangeBetween(0, window_days)
    windows = days.select(
        *keys,
        "day",
        F.max("day").over(ahead).alias("last_day"),
        F.min("recipient_name").over(ahead).alias("recipient_name"),
        F.col("_members").alias("donors"),
        F.sum("gifts").over(ahead).alias("donations"),
        F.sum("amount").over(ahead).alias("total_amount"),
    ).filter(F.col("donors") >= min_donors)
    best = first_per_key(windows, keys, [F.col("donors").desc(), F.col("total_amount").desc(), F.col("day")])
    order = [F.col("donors").desc(), F.col("total_amount").desc(), F.col("candidate_id")]
    leads = top(
        best.select(
            F.concat_ws("|", *keys).alias("candidate_id"),
            "recipient_id",
            "recipient_name",
            "shared_by",
            "shared_value",
            F.date_from_unix_date(F.col("day").cast("int")).alias("window_start"),
            F.date_from_unix_date(F.col("last_day").cast("int")).alias("window_end"),
            "donors",
            "donations",
            "total_amount",
        ),
        order,
        limit,
    )
    # Names only for the reported windows.
    named = gifts.select(*keys, "donor_name", F.date_from_unix_date(F.col("day").cast("int")).alias("_given"))
    return with_joined_list(
        leads, named, keys, "donor_name", "donor_names", residual="_given BETWEEN window_start AND window_end"
    ).transform(in_order(order, limit))


def new_recipient_single_funder(
    donations: DataFrame,
    recipients: DataFrame,
    *,
    max_age_days: int = 90,
    min_top_share: float = 0.9,
    min_total: float = 10000,
    limit: int | None = None,
) -> DataFrame:
    """Recently registered recipients whose early money nearly all came from one donor."""
    checks.integer("max_age_days", max_age_days, 1, 3650)
    checks.number("min_top_share", min_top_share, 0.5, 1)
    checks.number("min_total", min_total, 0, 10_000_000_000)
    checks.row_limit(limit)

    # One row per recipient, donor and day before the join: a hot recipient shrinks here.
    gifts = (
        donations.filter("amount > 0 AND donation_date IS NOT NULL")
        .groupBy("recipient_id", upper_trim("donor_name").alias("donor_key"), "donation_date")
        .agg(
            F.min("donor_name").alias("donor_name"),
            F.count(F.lit(1)).alias("gifts"),
            F.sum("amount").alias("amount"),
        )
    )
    registered = recipients.filter("registered_date IS NOT NULL").select(
        "recipient_id", F.col("name").alias("recipient_name"), "registered_date"
    )
    early = gifts.join(registered, "recipient_id").filter(
        F.col("donation_date") <= F.date_add("registered_date", max_age_days)
    )
    by_donor = early.groupBy("recipient_id", "donor_key").agg(
        F.min("donor_name").alias("donor_name"),
        F.sum("amount").alias("donor_amount"),
        F.sum("gifts").alias("gifts"),
        F.min("recipient_name").alias("recipient_name"),
        F.min("registered_date").alias("registered_date"),
        F.min("donation_date").alias("first_date"),
        F.max("donation_date").alias("last_date"),
    )
    # Highest amount, then lowest donor key with NULL last.
    rank = F.struct(-F.col("donor_amount"), F.col("donor_key").isNull(), F.col("donor_key"))
    totals = by_donor.groupBy("recipient_id").agg(
        F.min("recipient_name").alias("recipient_name"),
        F.min("registered_date").alias("registered_date"),
        F.min("first_date").alias("first_donation_date"),
        F.max("last_date").alias("last_donation_date"),
        F.count("donor_key").alias("donors"),
        F.sum("gifts").alias("donations"),
        F.sum("donor_amount").alias("total_amount"),
        F.min_by(F.struct("donor_name", "donor_amount"), rank).alias("largest"),
    )
    share = F.col("largest.donor_amount") / F.col("total_amount")
    return top(
        totals.filter((F.col("total_amount") >= min_total) & (share >= min_top_share)).select(
            F.col("recipient_id").alias("candidate_id"),
            "recipient_id",
            "recipient_name",
            "registered_date",
            "first_donation_date",
            "last_donation_date",
            "donors",
            "donations",
            "total_amount",
            F.col("largest.donor_name").alias("top_donor"),
            F.col("largest.donor_amount").alias("top_donor_amount"),
            decimal_round(share, 4).alias("top_share"),
        ),
        [F.col("total_amount").desc(), F.col("recipient_id")],
        limit,
    )


def structured_gifts(
    donations: DataFrame,
    *,
    threshold: float = 11180,
    window_days: int = 30,
    min_gifts: int = 3,
    limit: int | None = None,
) -> DataFrame:
    """Gifts from one donor, each under a threshold, that together reach it within a window."""
    checks.number("threshold", threshold, 1, 100_000_000)
    checks.integer("window_days", window_days, 1, 366)
    checks.integer("min_gifts", min_gifts, 2, 100)
    checks.row_limit(limit)

    postcode = F.nullif(postcode_key("donor_postcode"), F.lit(""))
    donor_key = F.concat(
        upper_trim("donor_name"), F.coalesce(F.concat(F.lit("|"), postcode), F.lit(""))
    )
    keys = ["recipient_id", "donor_key"]
    daily = (
        donations.filter(
            (F.col("amount") > 0) & (F.col("amount") < float(threshold)) & F.col("donation_date").isNotNull()
        )
        .select("*", donor_key.alias("donor_key"), day_number("donation_date").alias("day"))
        .filter("recipient_id IS NOT NULL AND donor_key IS NOT NULL")
        .groupBy(*keys, "day")
        .agg(
            F.count(F.lit(1)).alias("gifts"),
            F.sum("amount").alias("amount"),
            F.max("amount").alias("largest"),
            F.min("recipient_name").alias("recipient_name"),
            F.min("donor_name").alias("donor_name"),
        )
    )
    # At most one row per calendar day is left for any recipient and donor.
    ahead = Window.partitionBy(*keys).orderBy("day").rangeBetween(0, window_days)
    windows = daily.select(
        *keys,
        "day",
        F.max("day").over(ahead).alias("last_day"),
        F.min("recipient_name").over(ahead).alias("recipient_name"),
        F.min("donor_name").over(ahead).alias("donor_name"),
        F.sum("gifts").over(ahead).alias("gifts"),
        F.sum("amount").over(ahead).alias("total_amount"),
        F.max("largest").over(ahead).alias("largest_gift"),
    ).filter((F.col("gifts") >= min_gifts) & (F.col("total_amount") >= threshold))
    best = first_per_key(windows, keys, [F.col("total_amount").desc(), F.col("day")])
    return top(
        best.select(
            F.concat_ws("|", *keys).alias("candidate_id"),
            "recipient_id",
            "recipient_name",
            "donor_name",
            F.date_from_unix_date(F.col("day").cast("int")).alias("window_start"),
            F.date_from_unix_date(F.col("last_day").cast("int")).alias("window_end"),
            "gifts",
            "total_amount",
            "largest_gift",
        ),
        [F.col("total_amount").desc(), F.col("candidate_id")],
        limit,
    )
