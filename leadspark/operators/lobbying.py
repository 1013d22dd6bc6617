"""Lobbying register detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions import checks
from leadspark.functions.ordered import day_number, nearest_days
from leadspark.functions.relational import in_order, top, with_joined_list
from leadspark.functions.text import contains_any, decimal_round, registrant_key, upper_trim
from leadspark.session import cut_lineage

# Committee name fragments in a former office, first match wins.
COMMITTEE_PHRASES = (
    ("armed_services", ("armed services",)),
    ("ways_means", ("ways and means",)),
    ("appropriations", ("appropriation",)),
    ("finance", ("finance",)),
    ("judiciary", ("judiciary",)),
    ("intelligence", ("intelligence",)),
    ("foreign_relations", ("foreign relations",)),
    ("foreign_affairs", ("foreign affairs",)),
    ("energy_commerce", ("energy and commerce", "energy & commerce")),
    ("homeland_security", ("homeland security",)),
    ("veterans_affairs", ("veterans",)),
    ("health", ("health",)),
    ("agriculture", ("agriculture",)),
)
# Issue codes each committee deals with.
COMMITTEE_ISSUE_CODES = {
    "armed_services": ("DEF", "HOM", "INT"),
    "ways_means": ("TAX", "BUD", "TRD", "HCR"),
    "appropriations": ("BUD", "DEF", "HCR", "EDU"),
    "finance": ("TAX", "BUD", "BAN", "FIN"),
    "judiciary": ("LAW", "IMM", "BNK", "CON", "CIV"),
    "intelligence": ("INT", "DEF", "HOM", "CSP"),
    "foreign_relations": ("FOR", "TRD", "DEF"),
    "foreign_affairs": ("FOR", "TRD", "DEF"),
    "energy_commerce": ("ENG", "HCR", "TEC", "TRA", "CPT"),
    "homeland_security": ("HOM", "IMM", "CSP"),
    "health": ("HCR", "MED", "HPI"),
    "agriculture": ("AGR", "FOO", "TRD"),
}
# Phrases of the text signals.
ESOTERIC_PHRASES = ("empress", "annuit coeptis", "king solomon", "sui generis")
TITLE_PHRASES = ("empress", "head of state", "assumed the presiden", "queen")
FOREIGN_GOVERNMENT_PHRASES = ("foreign government", "embassy", "fara", "sanctions", "ambassador")
STATE_OWNED_PHRASES = (
    "national oil", "state-owned", "national bank", "republic of", "kingdom of", "ministry of", "embassy of",
)
HOME_COUNTRY_NAMES = ("US", "United States of America")
NO_OFFICE = ("none", "n/a", "null", "not applicable")


def _midpoint() -> Column:
    """Middle of the money range; a one-sided range stands for its known bound."""
    return (F.coalesce("spend_low", "spend_high") + F.coalesce("spend_high", "spend_low")) / 2.0


def _recent() -> Column:
    """Filing year 2024 to 2026, as a date range that reaches the file scan."""
    return F.col("period_start").between(F.lit("2024-01-01").cast("date"), F.lit("2026-12-31").cast("date"))


def spending_spikes(
    lobbying_registrations: DataFrame, *, min_spend: float = 50_000, min_z_abs: float = 2.0, limit: int | None = None
) -> DataFrame:
    """Periods in which a registrant's spend jumps against its previous four periods."""
    checks.number("min_spend", min_spend, 0, 1_000_000_000)
    checks.number("min_z_abs", min_z_abs, 0.0, 1000.0)
    checks.row_limit(limit)
    # Amendments repeat a client and period; the highest value counts once.
    reports = (
        lobbying_registrations.filter(F.coalesce("spend_low", "spend_high").isNotNull())
        .groupBy(
            "register",
            "registrant_id",
            F.coalesce("client_id", "client_name", F.lit("")).alias("client_key"),
            "period_start",
        )
        .agg(F.min("registrant_name").alias("registrant_name"), F.max(_midpoint()).alias("spend"))
    )
    periods = reports.groupBy("register", "registrant_id", "period_start").agg(
        F.min("registrant_name").alias("registrant_name"), F.sum("spend").alias("total_spend")
    )
    # One row per period is left for a registrant.
    prior = (
        Window.partitionBy("register", "registrant_id")
        .orderBy(F.col("period_start").asc_nulls_last())
        .rowsBetween(-4, -1)
    )
    scored = periods.select(
        "register",
        "registrant_id",
        "registrant_name",
        "period_start",
        "total_spend",
        F.avg("total_spend").over(prior).alias("prior_mean"),
        F.stddev_pop("total_spend").over(prior).alias("prior_sd"),
        F.count(F.lit(1)).over(prior).alias("prior_n"),
    ).filter((F.col("prior_n") >= 3) & (F.col("prior_sd") > 0) & (F.col("total_spend") >= min_spend))
    scored = scored.withColumn("z_score", (F.col("total_spend") - F.col("prior_mean")) / F.col("prior_sd"))
    return top(
        scored.filter(F.abs("z_score") >= min_z_abs),
        [
            F.abs("z_score").desc(),
            F.col("registrant_id").asc_nulls_last(),
            F.col("period_start"),
            F.col("register").asc_nulls_last(),
        ],
        limit,
    )


def missing_spend_filings(
    lobbying_registrations: DataFrame, *, min_filings: int = 4, limit: int | None = None
) -> DataFrame:
    """Registrants with repeated reports without money, in a kind of report that normally has it."""
    checks.integer("min_filings", min_filings, 1, 1000)
    checks.row_limit(limit)
    # The kind stays in the key until the kinds with money are known, so rows shrink before the join.
    per_kind = (
        lobbying_registrations.filter("register IS NOT NULL")
        .groupBy(
            "register",
            F.coalesce("filing_type", F.lit("")).alias("kind"),
            "registrant_id",
            F.coalesce("client_id", "client_name", F.lit("")).alias("client_key"),
            "period_start",
        )
        .agg(
            F.min("registrant_name").alias("registrant_name"),
            F.max(F.coalesce("spend_low", "spend_high")).alias("spend"),
        )
    )
    money_kinds = (
        lobbying_registrations.filter(F.coalesce("spend_low", "spend_high").isNotNull())
        .select("register", F.coalesce("filing_type", F.lit("")).alias("kind"))
        .distinct()
    )
    reports = (
        per_kind.join(money_kinds, ["register", "kind"], "left_semi")
        .groupBy("register", "registrant_id", "client_key", "period_start")
        .agg(F.min("registrant_name").alias("registrant_name"), F.max("spend").alias("spend"))
    )
    return top(
        reports.filter("spend IS NULL")
        .groupBy("register", "registrant_id")
        .agg(
            F.min("registrant_name").alias("registrant_name"),
            F.count(F.lit(1)).alias("reports_without_spend"),
            F.count_distinct(F.nullif("client_key", F.lit(""))).alias("distinct_clients"),
            F.min("period_start").alias("first_seen"),
            F.max("period_start").alias("last_seen"),
        )
        .filter(F.col("reports_without_spend") >= min_filings),
        [
            F.col("reports_without_spend").desc(),
            F.col("distinct_clients").desc(),
            F.col("registrant_id").asc_nulls_last(),
            F.col("register"),
        ],
        limit,
    )


def revolving_door_candidates(
    lobbyists: DataFrame, lobbying_registrations: DataFrame, *, limit: int | None = None
) -> DataFrame:
    """Lobbyists with a former public office, and whom they lobby for now."""
    checks.row_limit(limit)
    office = F.trim("former_public_office")
    former = (
        lobbyists.filter((F.length(office) >= 4) & ~F.lower(office).isin(*NO_OFFICE))
        .groupBy("lobbyist_id")
        .agg(
            F.min("name").alias("name"),
            F.min("former_public_office").alias("sample_office"),
            F.min("former_office_institution").alias("sample_institution"),
            F.max("former_office_end").alias("latest_office_end"),
            F.count_distinct("registration_id").alias("registrations_with_lobbyist"),
            F.count_distinct("former_public_office").alias("distinct_offices"),
        )
    )
    order = [F.col("registrations_with_lobbyist").desc(), F.col("lobbyist_id").asc_nulls_last()]
    leads = top(former, order, limit)
    # Only the filings of reported lobbyists are looked up.
    filings = lobbyists.select("lobbyist_id", "registration_id").join(
        lobbying_registrations.select(
            "registration_id", F.coalesce("client_name", "registrant_name").alias("represented")
        ),
        "registration_id",
        "left",
    )
    return with_joined_list(leads, filings, ["lobbyist_id"], "represented", "lobbied_for").transform(in_order(order, limit))


def foreign_filings(
    lobbying_registrations: DataFrame, lobbying_foreign_entities: DataFrame, *, limit: int | None = None
) -> DataFrame:
    """Filings that list a foreign entity with an interest in the lobbying."""
    checks.row_limit(limit)
    joined = lobbying_foreign_entities.join(lobbying_registrations, "registration_id").select(
        "registration_id",
        "period_start",
        "registrant_name",
        "client_name",
        "client_country",
        "client_ppb_country",
        "foreign_entity_name",
        F.col("country").alias("foreign_entity_country"),
        F.col("ppb_country").alias("foreign_entity_ppb"),
        F.col("spend_high").alias("spend"),
        "url",
    )
    first = ["registration_id", "foreign_entity_name"]
    others = [name for name in joined.columns if name not in [*first, "spend"]]
    return top(
        joined,
        [F.col("spend").desc_nulls_last(), *[F.col(name).asc_nulls_last() for name in [*first, *others]]],
        limit,
    )


def _client_reports(lobbying_registrations: DataFrame) -> DataFrame:
    """One row per registrant, client and period, amendments folded in."""
    return lobbying_registrations.groupBy(
        "register", "registrant_id", F.coalesce("client_id", "client_name").alias("client_key"), "period_start"
    ).agg(
        F.min("registrant_name").alias("registrant_name"),
        F.min("client_name").alias("client_name"),
        F.count_distinct("registration_id").alias("rows_in_period"),
        F.max(_midpoint()).alias("spend"),
    )


def single_client_juggernauts(
    lobbying_registrations: DataFrame, *, min_total_spend: float = 250_000, limit: int | None = None
) -> DataFrame:
    """Consultants with one or two clients and a high total spend."""
    checks.number("min_total_spend", min_total_spend, 0, 10_000_000_000)
    checks.row_limit(limit)
    reports = _client_reports(lobbying_registrations.filter(F.coalesce("client_id", "client_name").isNotNull()))
    order = [
        F.col("total_spend").desc(),
        F.col("registrant_id").asc_nulls_last(),
        F.col("register").asc_nulls_last(),
    ]
    leads = top(
        reports.groupBy("register", "registrant_id")
        .agg(
            F.min("registrant_name").alias("registrant_name"),
            F.count_distinct("client_key").alias("distinct_clients"),
            F.sum("rows_in_period").alias("registrations"),
            F.sum("spend").alias("total_spend"),
            F.min("period_start").alias("earliest_period"),
            F.max("period_start").alias("latest_period"),
        )
        .filter(F.col("distinct_clients").between(1, 2) & (F.col("total_spend") >= min_total_spend)),
        order,
        limit,
    )
    return with_joined_list(leads, reports, ["register", "registrant_id"], "client_name", "clients").transform(in_order(order, limit))


def pac_contribution_flow(political_contributions: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Contributions summed per payee and honoree."""
    checks.row_limit(limit)
    return top(
        political_contributions.filter("payee_name IS NOT NULL OR honoree_name IS NOT NULL")
        .groupBy("payee_name", "honoree_name")
        .agg(
            F.count(F.lit(1)).alias("n_contributions"),
            F.sum(F.coalesce("amount", F.lit(0.0))).alias("total_amount"),
            F.count_distinct("registration_id").alias("distinct_reports"),
            F.count_distinct("contributor_name").alias("distinct_contributors"),
        ),
        [
            F.col("total_amount").desc_nulls_last(),
            F.col("payee_name").asc_nulls_last(),
            F.col("honoree_name").asc_nulls_last(),
        ],
        limit,
    )


def issue_concentration_shifts(
    lobbying_registrations: DataFrame, *, min_delta_pct: float = 25, limit: int | None = None
) -> DataFrame:
    """Shifts in spend (without money: registrants) per issue from one quarter to the next."""
    checks.number("min_delta_pct", min_delta_pct, 0, 100_000)
    checks.row_limit(limit)
    areas = F.transform(F.split("issue_area", r"\|"), lambda area: F.trim(area))
    issues = lobbying_registrations.filter("issue_area IS NOT NULL").select(
        "register",
        "registrant_id",
        F.trunc("period_start", "quarter").alias("quarter"),
        F.explode(areas).alias("issue_area"),
        _midpoint().alias("spend"),
    )
    quarters = (
        issues.filter("issue_area <> ''")
        .groupBy("register", "issue_area", "quarter")
        .agg(F.count_distinct("registrant_id").alias("registrants"), F.sum("spend").alias("total_spend"))
    )
    # One row per quarter is left for an issue.
    in_time = Window.partitionBy("register", "issue_area").orderBy(F.col("quarter").asc_nulls_last())
    changes = quarters.select(
        "*",
        F.lag("total_spend").over(in_time).alias("prior_spend"),
        F.lag("registrants").over(in_time).alias("prior_registrants"),
    ).select(
        "register",
        "issue_area",
        "quarter",
        "registrants",
        "prior_registrants",
        F.when(
            F.col("prior_registrants") > 0,
            decimal_round(100.0 * (F.col("registrants") - F.col("prior_registrants")) / F.col("prior_registrants"), 1),
        ).alias("registrants_delta_pct"),
        "total_spend",
        "prior_spend",
        F.when(
            F.col("prior_spend") > 0,
            decimal_round(100.0 * (F.col("total_spend") - F.col("prior_spend")) / F.col("prior_spend"), 1),
        ).alias("spend_delta_pct"),
    )
    by_money = (F.col("prior_spend") > 0) & (F.abs("spend_delta_pct") >= min_delta_pct)
    by_count = (
        F.col("prior_spend").isNull()
        & (F.col("prior_registrants") > 0)
        & (F.abs("registrants_delta_pct") >= min_delta_pct)
    )
    size = F.abs(
        F.coalesce(
            F.col("total_spend") - F.col("prior_spend"),
            (F.col("registrants") - F.col("prior_registrants")).cast("double"),
        )
    )
    return top(
        changes.filter(by_money | by_count),
        [
            size.desc_nulls_last(),
            F.col("issue_area"),
            F.col("quarter").asc_nulls_last(),
            F.col("register").asc_nulls_last(),
        ],
        limit,
    )


def new_registrant_surge(
    lobbying_registrations: DataFrame, *, lookback_days: int = 183, limit: int | None = None
) -> DataFrame:
    """Registrants first seen in the latest days of their register."""
    checks.integer("lookback_days", lookback_days, 1, 3660)
    checks.row_limit(limit)
    per_registrant = (
        lobbying_registrations.filter("register IS NOT NULL")
        .groupBy("register", "registrant_id")
        .agg(F.min("period_start").alias("first_seen"), F.max("period_start").alias("last_seen"))
    )
    latest = per_registrant.groupBy("register").agg(F.max("last_seen").alias("latest"))
    newcomers = (
        per_registrant.filter("registrant_id IS NOT NULL")
        .join(latest, "register")
        .filter(F.col("first_seen") > F.date_sub("latest", lookback_days))
        .select("register", "registrant_id")
    )
    reports = _client_reports(
        lobbying_registrations.join(newcomers, ["register", "registrant_id"], "left_semi")
    )
    order = [
        F.col("total_spend").desc_nulls_last(),
        F.col("distinct_clients").desc(),
        F.col("registrations").desc(),
        F.col("registrant_id"),
        F.col("register"),
    ]
    leads = top(
        reports.groupBy("register", "registrant_id").agg(
            F.min("registrant_name").alias("registrant_name"),
            F.min("period_start").alias("first_period"),
            F.sum("rows_in_period").alias("registrations"),
            F.count_distinct("client_key").alias("distinct_clients"),
            F.sum("spend").alias("total_spend"),
        ),
        order,
        limit,
    )
    return with_joined_list(leads, reports, ["register", "registrant_id"], "client_name", "clients").transform(in_order(order, limit))


def _filings_mentioning(lobbying_activities: DataFrame, phrases: tuple[str, ...], alias: str) -> DataFrame:
    """Filings whose activity descriptions, joined by blanks in order, hold one of the phrases.

    The descriptions are not gathered into one text. A phrase lies within one
    description (a conditional aggregate), or, if it has two words, ends one
    description and starts the next; only filings that have both such a
    beginning and such an end are put in order to check that they are neighbours.
    """
    text = F.lower(F.coalesce("description", F.lit("")))
    within = (
        lobbying_activities.filter(contains_any("description", phrases))
        .select("registration_id")
        .distinct()
    )
    pairs = [tuple(phrase.split(" ", 1)) for phrase in phrases if " " in phrase]
    found = within
    if pairs:
        tail = F.coalesce(*[F.when(text.endswith(first), F.lit(i)) for i, (first, _) in enumerate(pairs)])
        head = F.coalesce(*[F.when(text.startswith(second), F.lit(i)) for i, (_, second) in enumerate(pairs)])
        marked = lobbying_activities.select(
            "registration_id", "activity_index", text.alias("_text"), tail.alias("_tail"), head.alias("_head")
        )
        split = (
            marked.filter("_tail IS NOT NULL OR _head IS NOT NULL")
            .groupBy("registration_id")
            .agg(F.count("_tail").alias("tails"), F.count("_head").alias("heads"))
            .filter("tails > 0 AND heads > 0")
        )
        in_order = Window.partitionBy("registration_id").orderBy(
            F.col("activity_index").asc_nulls_last(), F.col("_text")
        )
        neighbours = (
            marked.join(split, "registration_id", "left_semi")
            .withColumn("_before", F.lag("_text").over(in_order))
            .filter(
                F.exists(
                    F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]),
                    lambda pair: F.col("_before").endswith(pair["a"]) & F.col("_text").startswith(pair["b"]),
                )
            )
        )
        found = found.unionByName(neighbours.select("registration_id")).distinct()
    return found.withColumn(alias, F.lit(True))


def shell_pattern_filings(
    lobbyists: DataFrame,
    lobbying_registrations: DataFrame,
    lobbying_activities: DataFrame,
    *,
    min_score: int = 2,
    limit: int | None = None,
) -> DataFrame:
    """Filings with several text signs of a self-styled sovereign or shell client."""
    checks.integer("min_score", min_score, 1, 6)
    checks.row_limit(limit)
    esoteric = _filings_mentioning(lobbying_activities, ESOTERIC_PHRASES, "_esoteric")
    # Offices are joined with ' | ', which no phrase holds, so one office at a time is enough.
    titled = (
        lobbyists.filter(contains_any("former_public_office", TITLE_PHRASES))
        .select("registration_id", F.lit(True).alias("_titled"))
        .distinct()
    )
    poster = F.coalesce("posted_by_name", F.lit(""))
    signals = {
        "sig_sovereign_client": contains_any("client_description", ("sovereign",)),
        "sig_established_govt": contains_any("client_description", ("established government",)),
        "sig_esoteric_terms": F.coalesce("_esoteric", F.lit(False)),
        "sig_self_styled_title": F.coalesce("_titled", F.lit(False)),
        "sig_posted_by_llc_slashes": poster.like("%/%/%") | poster.contains("LLC"),
        "sig_global_pbc_naming": F.upper(F.coalesce("client_name", F.lit(""))).contains("GLOBAL PUBLIC BENEFIT"),
    }
    scored = (
        lobbying_registrations.join(esoteric, "registration_id", "left")
        .join(titled, "registration_id", "left")
        .select(
            "registration_id",
            "period_start",
            "filing_type",
            "registrant_name",
            "client_name",
            F.col("client_description").alias("client_desc"),
            F.col("spend_high").alias("spend"),
            *[signal.cast("int").alias(name) for name, signal in signals.items()],
            "url",
        )
    )
    score = sum((F.col(name) for name in list(signals)[1:]), F.col(next(iter(signals))))
    columns = [
        "registration_id", "period_start", "filing_type", "registrant_name", "client_name", "client_desc", "spend",
    ]
    return top(
        scored.withColumn("shell_score", score)
        .filter(F.col("shell_score") >= min_score)
        .select(*columns, "shell_score", *signals, "url"),
        [
            F.col("shell_score").desc(),
            F.col("spend").desc_nulls_last(),
            F.col("registration_id").asc_nulls_last(),
            F.col("period_start"),
            F.col("filing_type").asc_nulls_last(),
        ],
        limit,
    )


def fara_gap_narrowed(
    lobbying_registrations: DataFrame,
    lobbying_foreign_entities: DataFrame,
    lobbying_activities: DataFrame,
    foreign_agent_registrants: DataFrame,
    *,
    limit: int | None = None,
) -> DataFrame:
    """Filings with signs of foreign interest by a registrant missing from the foreign agent list."""
    checks.row_limit(limit)
    filings = (
        lobbying_registrations.filter(_recent())
        .select(
            "registration_id",
            F.year("period_start").cast("long").alias("filing_year"),
            "registrant_name",
            "client_name",
            "client_country",
            "client_ppb_country",
            F.col("spend_high").alias("spend"),
            "url",
        )
        .join(lobbying_foreign_entities.select("registration_id").distinct(), "registration_id", "left_semi")
        .distinct()
        .withColumn("_registrant", registrant_key("registrant_name"))
    )
    registered = foreign_agent_registrants.select(registrant_key("registrant_name").alias("_registrant")).distinct()
    topics = _filings_mentioning(lobbying_activities, FOREIGN_GOVERNMENT_PHRASES, "_topic")
    signals = {
        "sig_non_us_client": F.coalesce(~F.col("client_country").isin(*HOME_COUNTRY_NAMES), F.lit(False)),
        "sig_non_us_ppb": F.coalesce(~F.col("client_ppb_country").isin(*HOME_COUNTRY_NAMES), F.lit(False)),
        "sig_foreign_gov_topic": F.coalesce("_topic", F.lit(False)),
        "sig_soe_pattern": contains_any("client_name", STATE_OWNED_PHRASES),
    }
    flagged = (
        filings.join(registered, "_registrant", "left_anti")
        .join(topics, "registration_id", "left")
        .select(
            "registration_id", "filing_year", "registrant_name", "client_name", "client_country",
            "client_ppb_country", "spend", *[signal.cast("int").alias(name) for name, signal in signals.items()],
            "url",
        )
        .filter(" + ".join(signals) + " > 0")
    )
    order = [
        F.col("spend").desc_nulls_last(),
        F.col("registration_id").asc_nulls_last(),
        F.col("client_name").asc_nulls_last(),
        F.col("url").asc_nulls_last(),
    ]
    leads = top(flagged, order, limit)
    leads = with_joined_list(
        leads, lobbying_foreign_entities, ["registration_id"], "country", "fe_countries", separator=","
    )
    return leads.select(
        "registration_id", "filing_year", "registrant_name", "client_name", "client_country", "client_ppb_country",
        "fe_countries", "spend", *signals, "url",
    ).transform(in_order(order, limit))


def revolving_door_committee_match(
    lobbyists: DataFrame,
    lobbying_registrations: DataFrame,
    lobbying_activities: DataFrame,
    *,
    limit: int | None = None,
) -> DataFrame:
    """Lobbyists who now lobby on the issues of the committee they worked for."""
    checks.row_limit(limit)
    office = F.col("former_public_office")
    committee = F.coalesce(
        *[F.when(contains_any(office, phrases), F.lit(name)) for name, phrases in COMMITTEE_PHRASES]
    )
    # The committee's issue codes as literals: no lookup table to join.
    codes = F.coalesce(
        *[
            F.when(F.col("former_committee") == name, F.array(*[F.lit(code) for code in issue_codes]))
            for name, issue_codes in COMMITTEE_ISSUE_CODES.items()
        ]
    )
    positions = (
        lobbyists.filter(F.length(office) >= 12)
        .select("lobbyist_id", "name", committee.alias("former_committee"), "former_public_office")
        .filter("former_committee IS NOT NULL AND lobbyist_id IS NOT NULL")
        .distinct()
        .withColumn("general_issue_code", F.explode(codes))
    )
    filings = lobbying_registrations.filter(
        _recent() & F.col("filing_type").isin("Q1", "Q2", "Q3", "Q4") & (F.col("spend_high") > 0)
    ).select(
        "registration_id", "period_start", "registrant_name", "client_name", F.col("spend_high").alias("spend"), "url"
    )
    # A filing and its activities are one row. Lobbyists meet the codes of their filings first, and only those whose
    # committee has one of them meet the texts: what is shuffled for the others is keys and codes.
    all_codes = sorted({code for issue_codes in COMMITTEE_ISSUE_CODES.values() for code in issue_codes})
    activities = lobbying_activities.filter(F.col("general_issue_code").isin(*all_codes)).select(
        "registration_id", F.struct("general_issue_code", "description").alias("_activity")
    )
    worked = filings.join(activities.groupBy("registration_id").agg(F.collect_list("_activity").alias("_activities")), "registration_id")
    asked = worked.select("registration_id", F.array_distinct("_activities.general_issue_code").alias("_codes"))
    met = (
        lobbyists.select("registration_id", "lobbyist_id")
        .join(asked.dropDuplicates(["registration_id"]), "registration_id")
        .join(positions, "lobbyist_id")
        .filter(F.array_contains("_codes", F.col("general_issue_code")))
        .drop("_codes")
    )
    own = F.filter("_activities", lambda activity: activity["general_issue_code"] == F.col("general_issue_code"))
    leads = met.join(worked, "registration_id").withColumn("_activity", F.explode(own)).withColumn("description", F.col("_activity.description"))
    columns = [
        "lobbyist_id", "name", "former_committee", "former_public_office", "registration_id", "period_start",
        "registrant_name", "client_name", "general_issue_code", "description", "spend", "url",
    ]
    first = ["lobbyist_id", "registration_id", "general_issue_code"]
    others = [name for name in columns if name not in [*first, "spend"]]
    return top(
        leads.select(*columns),
        [F.col("spend").desc_nulls_last(), *[F.col(name).asc_nulls_last() for name in [*first, *others]]],
        limit,
    )


def committee_say_vs_pay(
    lobbyists: DataFrame,
    lobbying_registrations: DataFrame,
    committee_assignments: DataFrame,
    legislators: DataFrame,
    press_releases: DataFrame,
    *,
    target_committee: str = "finance",
    client_pattern: str = "%apollo%",
    limit: int | None = None,
) -> DataFrame:
    """Lobbying for a client by former committee staff, next to what the committee's members publish about it."""
    checks.text("target_committee", target_committee, 200)
    checks.text("client_pattern", client_pattern, 200)
    checks.row_limit(limit)
    committee_pattern = f"%{target_committee}%"
    positions = (
        lobbyists.filter(F.lower("former_public_office").like(committee_pattern))
        .select("lobbyist_id", F.col("name").alias("lobbyist"), F.col("former_public_office").alias("former_role"))
        .distinct()
    )
    members = (
        committee_assignments.filter(F.lower("committee_name").like(committee_pattern))
        .join(legislators, "bioguide_id")
        .select("bioguide_id", "name", "party", "state", "role")
        .distinct()
    )
    text = F.lower("text")
    attacks = press_releases.filter(text.like(client_pattern) & text.contains("private equity"))
    member_count = members.agg(F.count(F.lit(1)).alias("n")).scalar()
    attack_count = attacks.agg(F.count(F.lit(1)).alias("n")).scalar()
    attacking_members = (
        attacks.join(members.select("bioguide_id").distinct(), "bioguide_id", "left_semi")
        .agg(F.count_distinct("member_name").alias("n"))
        .scalar()
    )
    filings = lobbying_registrations.filter(F.lower("client_name").like(client_pattern) & _recent()).select(
        "registration_id",
        F.col("registrant_name").alias("lobbying_firm"),
        F.col("client_name").alias("lobbied_client"),
        F.col("spend_high").alias("spend"),
    )
    lobbying = (
        filings.join(lobbyists.select("registration_id", "lobbyist_id"), "registration_id")
        .join(positions, "lobbyist_id")
        .select("registration_id", "lobbying_firm", "lobbied_client", "spend", "lobbyist", "former_role")
        .distinct()
    )
    ranked = top(
        lobbying,
        [
            F.col("spend").desc_nulls_last(),
            F.col("registration_id"),
            F.col("lobbyist").asc_nulls_last(),
            F.col("former_role"),
            F.col("lobbying_firm").asc_nulls_last(),
        ],
        limit,
    )
    return ranked.select(
        "lobbying_firm",
        "lobbied_client",
        "lobbyist",
        "former_role",
        member_count.alias("current_committee_members"),
        attack_count.alias("attack_press_releases"),
        attacking_members.alias("committee_members_attacking"),
        "spend",
    )


def foreign_clients(
    lobbying_registrations: DataFrame, *, home_countries: str = "", limit: int | None = None
) -> DataFrame:
    """Registrations for interests outside the register's home countries.

    Without declared home countries a register's home is its most frequent
    client country, the first in order among equally frequent ones.
    """
    checks.text("home_countries", home_countries, 1000)
    checks.row_limit(limit)
    country = upper_trim("client_country")
    located = lobbying_registrations.filter((country != "") & F.col("register").isNotNull()).withColumn(
        "_country", country
    )
    declared = home_countries.strip().upper()
    if declared:
        homes = [item.strip() for item in declared.split("|")]
        outside = located.filter(~F.col("_country").isin(*homes)).withColumn("home_countries", F.lit("|".join(homes)))
    else:
        per_country = located.groupBy("register", "_country").agg(F.count(F.lit(1)).alias("rows"))
        inferred = per_country.groupBy("register").agg(
            F.min_by("_country", F.struct(-F.col("rows"), F.col("_country"))).alias("home_countries")
        )
        outside = located.join(inferred, "register").filter("_country <> home_countries")
    return top(
        outside.select(
            "register",
            "registration_id",
            "period_start",
            "registrant_id",
            "registrant_name",
            F.coalesce("client_name", "registrant_name").alias("represented"),
            "client_country",
            "home_countries",
            "spend_low",
            "spend_high",
            "url",
        ),
        [
            F.coalesce("spend_high", "spend_low").desc_nulls_last(),
            F.col("registration_id").asc_nulls_last(),
            F.col("represented").asc_nulls_last(),
            F.col("register"),
            F.col("period_start"),
            F.col("url").asc_nulls_last(),
        ],
        limit,
    )


# An institution name must be this long to count when it is only part of another.
CONTAINED_NAME_LENGTH = 6


def _same_institution(former_keys: DataFrame, contacted_keys: DataFrame) -> DataFrame:
    """Pairs (registrant, former institution, contacted institution) that are equal or contain each other.

    A name of six or more characters lies in another only if the other holds its
    first six characters, so containment joins on (registrant, six characters)
    and then checks the whole names; no registrant's names are all paired.
    """
    start = CONTAINED_NAME_LENGTH

    def pieces(text: Column) -> Column:
        last = F.greatest(F.length(text) - (start - 1), F.lit(1))
        return F.array_distinct(
            F.transform(F.sequence(F.lit(1), last), lambda n: F.substring(text, n, F.lit(start)))
        )

    def contained(short: DataFrame, short_key: str, long: DataFrame, long_key: str) -> DataFrame:
        return (
            short.filter(F.length(short_key) >= start)
            .withColumn("_piece", F.substring(short_key, 1, start))
            .join(long.withColumn("_piece", F.explode(pieces(F.col(long_key)))), ["registrant_id", "_piece"])
            .filter(F.col(long_key).contains(F.col(short_key)))
            .select("registrant_id", "former_key", "contacted_key")
        )

    equal = former_keys.withColumn("contacted_key", F.col("former_key")).join(
        contacted_keys, ["registrant_id", "contacted_key"], "left_semi"
    )
    return (
        equal.select("registrant_id", "former_key", "contacted_key")
        .unionByName(contained(former_keys, "former_key", contacted_keys, "contacted_key"))
        .unionByName(contained(contacted_keys, "contacted_key", former_keys, "former_key"))
        .distinct()
    )


def _merged_spans(spans: Column) -> Column:
    """Sorted spans (first, last) as disjoint ones."""

    def added(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"))
        return (
            F.when(F.size(done) == 0, F.array(span))
            .when(span["first"] <= F.try_element_at(done, F.lit(-1))["last"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)))
            .otherwise(F.concat(done, F.array(span)))
        )

    empty = F.array().cast("array<struct<first:int,last:int>>")
    return F.aggregate(spans, empty, added)


def _contacts_in_covers(covers: DataFrame, dated: DataFrame, place: list[str]) -> DataFrame:
    """``covers`` (place and disjoint spans of days) with ``_members``: the distinct contacts that have a day in a span.

    Every contact counts on its first day: running counts per place and day, read at
    both ends of each span, so contacts never meet covers. Only a contact with several
    days is looked at again, as it may be covered on a later one.
    """
    meetings = dated.groupBy(*place, "contact_id").agg(F.array_sort(F.collect_set("day")).alias("_days"))
    spans = covers.select(*place, F.explode("cover").alias("_span")).select(*place, "_span.first", "_span.last").distinct()
    asked = spans.select(*place, (F.col("first") - 1).alias("day")).unionByName(spans.select(*place, F.col("last").alias("day")))
    marks = meetings.select(*place, F.col("_days")[0].alias("day"), F.lit(1).alias("_n")).unionByName(asked.withColumn("_n", F.lit(0)))
    order = Window.partitionBy(*place).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = marks.groupBy(*place, "day").agg(F.sum("_n").alias("_n")).select(*place, "day", F.sum("_n").over(order).alias("_until"))
    ends = running.select(*place, F.col("day").alias("last"), F.col("_until").alias("_to"))
    starts = running.select(*place, (F.col("day") + 1).alias("first"), F.col("_until").alias("_from"))
    inside = spans.join(ends, [*place, "last"]).join(starts, [*place, "first"])
    inside = inside.select(*place, F.struct("first", "last").alias("_span"), (F.col("_to") - F.col("_from")).alias("_in"))
    firsts = (
        covers.select(*place, "cover", F.explode("cover").alias("_span"))
        .join(inside, [*place, "_span"])
        .groupBy(*place, "cover")
        .agg(F.sum("_in").alias("_members"))
    )

    def covered(day: Column) -> Column:
        return F.exists("cover", lambda span: day.between(span["first"], span["last"]))

    later = (
        covers.join(meetings.filter(F.size("_days") > 1).select(*place, "_days"), place)
        .filter(~covered(F.col("_days")[0]) & F.exists("_days", covered))
        .groupBy(*place, "cover")
        .agg(F.count("*").alias("_later"))
    )
    return firsts.join(later, [*place, "cover"], "left").select(
        *place, "cover", (F.col("_members") + F.coalesce("_later", F.lit(0))).alias("_members")
    )


def former_official_lobbies_former_institution(
    lobbyists: DataFrame,
    lobbying_registrations: DataFrame,
    lobbying_contacts: DataFrame,
    *,
    max_days_after_leaving: int = 1825,
    limit: int | None = None,
) -> DataFrame:
    """Contacts of a registrant with an institution where one of its lobbyists held office.

    A leaving date opens a window of days. It is narrowed to the first and last contact
    day in it; a lobbyist's windows at one place are merged into disjoint spans. Distinct contacts and
    the officials met are worked out once for each place (registrant and institution) and each
    set of spans there, which all lobbyists share who left at such times, or at unknown ones.
    """
    checks.integer("max_days_after_leaving", max_days_after_leaving, 0, 36_500)
    checks.row_limit(limit)
    former = (
        lobbyists.filter(F.length(F.trim(F.coalesce("former_office_institution", F.lit("")))) >= 3)
        .join(lobbying_registrations.select("registration_id", "registrant_id"), "registration_id")
        .filter("registrant_id IS NOT NULL")
        .groupBy("lobbyist_id", "former_office_institution", "registrant_id", "former_office_end")
        .agg(F.min("name").alias("name"), F.min("former_public_office").alias("former_public_office"))
        .withColumn("former_key", F.lower(F.trim("former_office_institution")))
    )
    contacts = lobbying_contacts.filter("registrant_id IS NOT NULL AND institution IS NOT NULL").select(
        "registrant_id",
        "registrant_name",
        "institution",
        F.lower(F.trim("institution")).alias("contacted_key"),
        "contact_id",
        day_number("contact_date").alias("day"),
        "official_name",
    )
    place = ["registrant_id", "contacted_key"]
    pairs = _same_institution(
        former.select("registrant_id", "former_key").distinct(), contacts.select(*place).distinct()
    )
    # All contacts of a place, dated or not.
    places = contacts.groupBy(*place).agg(
        F.min("registrant_name").alias("registrant_name"),
        F.min("institution").alias("contacted_institution"),
        F.count_distinct("contact_id").alias("_all"),
        F.min("day").alias("_first"),
        F.max("day").alias("_last"),
    )
    dated = contacts.filter("day IS NOT NULL").select(*place, "contact_id", "day").distinct()
    # Written once: the branches below read them.
    terms = cut_lineage(former.join(pairs, ["registrant_id", "former_key"]).drop("former_key"))
    leaving = terms.select(*place, day_number("former_office_end").alias("day")).filter("day IS NOT NULL").distinct()
    until = leaving.select(*place, (F.col("day") + max_days_after_leaving).alias("day"))
    nearest = nearest_days(dated, leaving.unionByName(until).distinct(), place, "day")
    windows = (
        leaving.join(nearest.select(*place, "day", F.col("_next").alias("first")), [*place, "day"])
        .join(
            nearest.select(*place, (F.col("day") - max_days_after_leaving).alias("day"), F.col("_previous").alias("last")),
            [*place, "day"],
        )
        .filter("first <= last")
        .select(*place, F.date_from_unix_date("day").alias("former_office_end"), F.struct("first", "last").alias("_span"))
    )
    lead_key = ["lobbyist_id", "former_office_institution", *place]
    spanned = terms.join(windows, [*place, "former_office_end"], "left").filter(
        "_span IS NOT NULL OR former_office_end IS NULL"
    )
    matched = cut_lineage(
        spanned.groupBy(*lead_key)
        .agg(
            F.min("name").alias("name"),
            F.min("former_public_office").alias("former_public_office"),
            F.max("former_office_end").alias("former_office_end"),
            F.max(F.col("former_office_end").isNull()).alias("_any_time"),
            F.array_sort(F.collect_set("_span")).alias("_spans"),
        )
        # An unknown leaving date admits every contact: the empty cover.
        .withColumn("cover", F.when(F.col("_any_time"), F.array().cast("array<struct<first:int,last:int>>")).otherwise(_merged_spans(F.col("_spans"))))
        .drop("_spans")
    )
    covers = matched.select(*place, "cover").distinct()
    some = covers.filter(F.size("cover") > 0)
    whole = covers.filter(F.size("cover") == 0)
    counts = _contacts_in_covers(some, dated, place).unionByName(
        whole.join(places.select(*place, F.col("_all").alias("_members")), place)
    )
    # Calendar days on which an official was met: one row for each official of a place.
    officials = contacts.groupBy(*place, "official_name").agg(F.collect_set("day").alias("_days"))
    met = covers.join(officials.filter("official_name IS NOT NULL"), place).filter(
        (F.size("cover") == 0)
        | F.exists("_days", lambda day: F.exists("cover", lambda span: day.between(span["first"], span["last"])))
    )
    listed = met.groupBy(*place, "cover").agg(F.array_join(F.array_sort(F.collect_list("official_name")), " | ").alias("officials"))
    facts = counts.join(listed, [*place, "cover"], "left").join(places.drop("_all"), place)
    first = F.when(F.size("cover") == 0, F.col("_first")).otherwise(F.try_element_at("cover", F.lit(1))["first"])
    last = F.when(F.size("cover") == 0, F.col("_last")).otherwise(F.try_element_at("cover", F.lit(-1))["last"])
    facts = facts.select(
        *place, "cover", "registrant_name", "contacted_institution", F.col("_members").alias("contacts"),
        F.date_from_unix_date(first).alias("first_contact"), F.date_from_unix_date(last).alias("last_contact"), "officials",
    )
    days = F.datediff("first_contact", "former_office_end").cast("long")
    leads = matched.join(facts, [*place, "cover"]).select(
        "lobbyist_id", "name", "former_public_office", "former_office_institution", "former_office_end",
        "registrant_id", "registrant_name", "contacted_institution", "contacts", "first_contact",
        "last_contact", days.alias("days_from_leaving_to_first_contact"), "officials",
    )
    order = [
        F.col("contacts").desc(),
        F.col("days_from_leaving_to_first_contact").asc_nulls_last(),
        F.col("lobbyist_id").asc_nulls_last(),
        F.col("former_office_institution"),
        F.col("registrant_id"),
        F.col("contacted_institution"),
    ]
    return top(leads, order, limit)


def contact_bursts(
    lobbying_contacts: DataFrame, *, min_contacts: int = 5, min_ratio: float = 3.0, limit: int | None = None
) -> DataFrame:
    """Months in which contacts of a registrant with an institution jump above their usual rate."""
    checks.integer("min_contacts", min_contacts, 1, 10_000)
    checks.number("min_ratio", min_ratio, 1.0, 1000.0)
    checks.row_limit(limit)
    contacts = lobbying_contacts.filter(
        "contact_date IS NOT NULL AND institution IS NOT NULL AND registrant_id IS NOT NULL"
    ).withColumn("month", F.trunc("contact_date", "month"))
    # contact_id first: a hot registrant and institution is spread over its contacts.
    monthly = contacts.groupBy("registrant_id", "institution", "month").agg(
        F.min("registrant_name").alias("registrant_name"), F.count_distinct("contact_id").alias("contacts")
    )
    # One row per month is left in this window.
    pair = Window.partitionBy("registrant_id", "institution")
    number_of_month = F.year("month") * 12 + F.month("month")
    rated = monthly.select(
        "*",
        F.sum("contacts").over(pair).alias("total_contacts"),
        (F.max(number_of_month).over(pair) - F.min(number_of_month).over(pair) + 1)
        .cast("long")
        .alias("active_months"),
    )
    mean = F.col("total_contacts") / F.col("active_months")
    ratio = F.col("contacts") / mean
    order = [
        F.col("burst_ratio").desc(),
        F.col("contacts").desc(),
        F.col("registrant_id"),
        F.col("month"),
        F.col("institution"),
    ]
    leads = top(
        rated.filter((F.col("contacts") >= min_contacts) & (F.try_divide(F.col("contacts"), mean) >= float(min_ratio)))
        .select(
            "registrant_id",
            "registrant_name",
            "institution",
            "month",
            "contacts",
            "total_contacts",
            "active_months",
            decimal_round(mean, 2).alias("mean_per_month"),
            decimal_round(ratio, 2).alias("burst_ratio"),
        ),
        order,
        limit,
    )
    return with_joined_list(
        leads, contacts, ["registrant_id", "institution", "month"], "official_name", "officials"
    ).transform(in_order(order, limit))
