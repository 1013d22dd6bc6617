"""Parliamentary detectors over roll calls, affiliations and declared interests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions import checks
from leadspark.functions.ordered import with_previous_row
from leadspark.functions.relational import top
from leadspark.functions.text import decimal_round


def _names(parl_members: DataFrame) -> DataFrame:
    return parl_members.groupBy("parliament", "member_id").agg(F.min("name").alias("name"))


def absence_outlier(
    parl_members: DataFrame,
    parl_votings: DataFrame,
    parl_member_votes: DataFrame,
    *,
    min_votings: int = 50,
    ratio: float = 2.0,
    min_rate: float = 0.1,
    limit: int | None = None,
) -> DataFrame:
    """Members absent far more often than the median member of their chamber."""
    checks.integer("min_votings", min_votings, 1, 100_000)
    checks.number("ratio", ratio, 1, 100)
    checks.number("min_rate", min_rate, 0, 1)
    checks.row_limit(limit)
    votings = parl_votings.select("parliament", "voting_id", F.coalesce("chamber", F.lit("")).alias("chamber_key"))
    position = F.lower("position")
    rolls = (
        parl_member_votes.filter(position.isin("for", "against", "abstain", "absent"))
        .select("parliament", "voting_id", "member_id", position.alias("position"))
        .join(votings, ["parliament", "voting_id"])
        .groupBy("parliament", "chamber_key", "member_id")
        .agg(F.count(F.lit(1)).alias("votings"), F.count_if(F.col("position") == "absent").alias("absences"))
        .filter(F.col("votings") >= min_votings)
        .withColumn("rate", F.col("absences") / F.col("votings"))
    )
    # Members with the same rate collapse before the exact median sees them.
    medians = (
        rolls.groupBy("parliament", "chamber_key", "rate")
        .agg(F.count(F.lit(1)).alias("members"))
        .groupBy("parliament", "chamber_key")
        .agg(F.percentile("rate", F.lit(0.5), F.col("members")).alias("median"))
    )
    flagged = rolls.join(medians, ["parliament", "chamber_key"]).filter(
        F.col("rate") >= F.greatest(F.lit(float(ratio)) * F.col("median"), F.lit(float(min_rate)))
    )
    return top(
        flagged.join(_names(parl_members), ["parliament", "member_id"], "left").select(
            "member_id",
            "name",
            "parliament",
            F.nullif("chamber_key", F.lit("")).alias("chamber"),
            "votings",
            "absences",
            decimal_round("rate", 4).alias("absence_rate"),
            decimal_round("median", 4).alias("median_rate"),
        ),
        [
            F.col("absence_rate").desc(),
            F.col("absences").desc(),
            F.col("member_id").asc_nulls_last(),
            F.col("parliament"),
            F.col("chamber").asc_nulls_last(),
        ],
        limit,
    )


def _votes_against_line(
    parl_votings: DataFrame, parl_member_votes: DataFrame, unattached_groups: str, min_group_size: int
) -> DataFrame:
    """Votes of group members next to their group's line, where the group has one.

    The line of a group in a voting is its single most frequent position; three
    conditional counts per group give it in one aggregation.
    """
    position = F.lower("position")
    votes = parl_member_votes.filter(
        position.isin("for", "against", "abstain") & F.col("group_at_vote").isNotNull()
    )
    # Every listed label counts, also an empty one from an empty list.
    unattached = [label.strip() for label in unattached_groups.split("|")]
    votes = (
        votes.filter(~F.col("group_at_vote").isin(*unattached))
        .select("parliament", "voting_id", "member_id", position.alias("position"), "group_at_vote")
        .join(parl_votings.select("parliament", "voting_id", "vote_date"), ["parliament", "voting_id"])
    )
    group = ["parliament", "voting_id", "group_at_vote"]
    top_count = F.greatest("n_for", "n_against", "n_abstain")
    lines = (
        votes.groupBy(*group)
        .agg(
            F.count_if(F.col("position") == "for").alias("n_for"),
            F.count_if(F.col("position") == "against").alias("n_against"),
            F.count_if(F.col("position") == "abstain").alias("n_abstain"),
        )
        .filter(F.col("n_for") + F.col("n_against") + F.col("n_abstain") >= min_group_size)
        .filter(
            F.size(F.filter(F.array("n_for", "n_against", "n_abstain"), lambda n: n == top_count)) == 1
        )
        .select(
            *group,
            F.when(F.col("n_for") == top_count, "for")
            .when(F.col("n_against") == top_count, "against")
            .otherwise("abstain")
            .alias("line"),
        )
    )
    return votes.join(lines, group)


def group_rebellion_rate(
    parl_members: DataFrame,
    parl_votings: DataFrame,
    parl_member_votes: DataFrame,
    *,
    unattached_groups: str = "NI|Fraktionslos",
    min_group_size: int = 3,
    min_votes: int = 50,
    min_rate: float = 0.1,
    limit: int | None = None,
) -> DataFrame:
    """Members who often vote against the line of their own group."""
    checks.text("unattached_groups", unattached_groups, 200)
    checks.integer("min_group_size", min_group_size, 2, 1000)
    checks.integer("min_votes", min_votes, 1, 100_000)
    checks.number("min_rate", min_rate, 0, 1)
    checks.row_limit(limit)
    compared = _votes_against_line(parl_votings, parl_member_votes, unattached_groups, min_group_size)
    # Latest dated vote decides; the larger group name breaks a tie.
    when_voted = F.when(F.col("vote_date").isNotNull(), F.struct("vote_date", "group_at_vote"))
    rates = (
        compared.groupBy("parliament", "member_id")
        .agg(
            F.max(when_voted).alias("latest"),
            F.count(F.lit(1)).alias("votes_compared"),
            F.count_if(F.col("position") != F.col("line")).alias("rebellions"),
        )
        .filter(F.col("votes_compared") >= min_votes)
        .withColumn("rate", F.col("rebellions") / F.col("votes_compared"))
        .filter(F.col("rate") >= float(min_rate))
    )
    return top(
        rates.join(_names(parl_members), ["parliament", "member_id"], "left").select(
            "member_id",
            "name",
            "parliament",
            F.col("latest.group_at_vote").alias("latest_group"),
            "votes_compared",
            "rebellions",
            decimal_round("rate", 4).alias("rebellion_rate"),
        ),
        [
            F.col("rebellion_rate").desc(),
            F.col("rebellions").desc(),
            F.col("member_id").asc_nulls_last(),
            F.col("parliament"),
        ],
        limit,
    )


def rebellion_rise(
    parl_members: DataFrame,
    parl_votings: DataFrame,
    parl_member_votes: DataFrame,
    *,
    unattached_groups: str = "NI|Fraktionslos",
    min_group_size: int = 3,
    min_votes_per_period: int = 30,
    min_increase: float = 0.2,
    limit: int | None = None,
) -> DataFrame:
    """Members whose share of votes against their group's line jumps from one quarter to the next."""
    checks.text("unattached_groups", unattached_groups, 200)
    checks.integer("min_group_size", min_group_size, 2, 1000)
    checks.integer("min_votes_per_period", min_votes_per_period, 1, 100_000)
    checks.number("min_increase", min_increase, 0, 1)
    checks.row_limit(limit)
    compared = _votes_against_line(
        parl_votings.filter("vote_date IS NOT NULL"), parl_member_votes, unattached_groups, min_group_size
    )
    periods = (
        compared.groupBy("parliament", "member_id", F.trunc("vote_date", "quarter").alias("period_start"))
        .agg(
            F.count(F.lit(1)).alias("votes_compared"),
            F.count_if(F.col("position") != F.col("line")).alias("rebellions"),
        )
        .filter(F.col("votes_compared") >= min_votes_per_period)
        .withColumn("rate", F.col("rebellions") / F.col("votes_compared"))
    )
    # One row per quarter and member is left.
    in_time = Window.partitionBy("parliament", "member_id").orderBy("period_start")
    changes = periods.select(
        "parliament",
        "member_id",
        F.lag("period_start").over(in_time).alias("previous_period_start"),
        "period_start",
        F.lag("votes_compared").over(in_time).alias("previous_votes_compared"),
        "votes_compared",
        F.lag("rate").over(in_time).alias("previous_rate"),
        "rate",
    ).filter(F.col("rate") - F.col("previous_rate") >= float(min_increase))
    return top(
        changes.join(_names(parl_members), ["parliament", "member_id"], "left").select(
            "member_id",
            "name",
            "parliament",
            "previous_period_start",
            "period_start",
            "previous_votes_compared",
            "votes_compared",
            decimal_round("previous_rate", 4).alias("previous_rate"),
            decimal_round("rate", 4).alias("rate"),
            decimal_round(F.col("rate") - F.col("previous_rate"), 4).alias("increase"),
        ),
        [
            F.col("increase").desc(),
            F.col("member_id").asc_nulls_last(),
            F.col("period_start"),
            F.col("parliament"),
        ],
        limit,
    )


def group_switch(
    parl_members: DataFrame,
    parl_affiliations: DataFrame,
    *,
    affiliation_type: str = "group",
    limit: int | None = None,
) -> DataFrame:
    """Moves of a member from one group or party to another within a term."""
    checks.text("affiliation_type", affiliation_type, 20)
    checks.row_limit(limit)
    spans = (
        parl_affiliations.filter(
            (F.col("affiliation_type") == affiliation_type)
            & F.col("start_date").isNotNull()
            & F.col("org_name").isNotNull()
        )
        .select(
            "parliament",
            "member_id",
            F.coalesce("term", F.lit("")).alias("term_key"),
            F.lower(F.trim("org_name")).alias("org_key"),
            "org_name",
            "start_date",
            "end_date",
        )
        .distinct()
    )
    # The end date sorts with NULL last: an open end is later than any date.
    ordered = with_previous_row(
        spans.withColumn("_open", F.col("end_date").isNull()),
        ["parliament", "member_id", "term_key"],
        F.year("start_date"),
        [F.col(name) for name in ("start_date", "_open", "end_date", "org_key", "org_name")],
        ["org_key", "org_name", "end_date"],
    )
    moves = ordered.filter(F.col("_previous.org_key") != F.col("org_key")).select(
        "parliament",
        "member_id",
        F.col("_previous.org_name").alias("from_org"),
        F.col("org_name").alias("to_org"),
        F.col("_previous.end_date").alias("from_end"),
        F.col("start_date").alias("switch_date"),
    )
    return top(
        moves.join(_names(parl_members), ["parliament", "member_id"], "left").select(
            "member_id", "name", "parliament", "from_org", "to_org", "from_end", "switch_date"
        ),
        [
            F.col("switch_date").desc(),
            F.col("member_id").asc_nulls_last(),
            F.col("parliament").asc_nulls_last(),
            F.col("from_org"),
            F.col("to_org"),
            F.col("from_end").asc_nulls_last(),
        ],
        limit,
    )


def outside_interests_load(
    parl_members: DataFrame,
    parl_interests: DataFrame,
    *,
    min_paid: int = 10,
    min_income: float = 100_000,
    limit: int | None = None,
) -> DataFrame:
    """Members with many paid outside mandates or a high declared outside income."""
    checks.integer("min_paid", min_paid, 1, 1000)
    checks.number("min_income", min_income, 0, 1_000_000_000)
    checks.row_limit(limit)
    current = (
        parl_interests.filter("end_date IS NULL")
        .select("parliament", "member_id", "interest_id", F.lower("paid").alias("paid"), "income_high")
        .distinct()
    )
    loads = (
        current.groupBy("parliament", "member_id")
        .agg(
            F.count(F.lit(1)).alias("interests"),
            F.count_if(F.col("paid") == "paid").alias("paid_interests"),
            F.count_if(F.col("paid") == "unpaid").alias("unpaid_interests"),
            F.sum("income_high").alias("income_high"),
        )
        .filter((F.col("paid_interests") >= min_paid) | (F.col("income_high") >= min_income))
    )
    return top(
        loads.join(_names(parl_members), ["parliament", "member_id"], "left").select(
            "member_id", "name", "parliament", "interests", "paid_interests", "unpaid_interests", "income_high"
        ),
        [
            F.col("paid_interests").desc(),
            F.col("income_high").desc_nulls_last(),
            F.col("member_id").asc_nulls_last(),
            F.col("parliament"),
        ],
        limit,
    )
