"""Company register detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions import checks
from leadspark.functions.relational import first_per_key, in_order, top, with_joined_list
from leadspark.functions.text import address_key, split_list, upper_trim
from leadspark.session import cut_lineage

# Fixed value: jurisdictions with a high financial secrecy score (ISO country codes).
SECRECY_JURISDICTIONS = (
    "US|CH|SG|HK|AE|GG|TW|KR|CN|PA|VG|KY|SA|JE|RU|MY|DZ|EG|BS|MT|NG|KZ|TH|MO|KW|GT|QA|KE|NZ|BD|VN|BH|BM|MU|"
    "JO|CL|LK|LI|UY|BO|MA|LB|TZ|IM|CW|BB|VE|SC|PK|KN|OM|SV|AW|NA|RS|WS|GI|CM|PR|BZ|AI|LC|FJ|TC|VI|GD|CK|VC|"
    "XK|BN|GU|MH|MC|AS|MV|TT|VU|GM|LR|AG|AO|MS"
)

PRUNING_ROUNDS = 2


def _further(walks: DataFrame, shorter: list[DataFrame], steps: DataFrame, closed: DataFrame | None, text: Column) -> DataFrame:
    """Walks one company longer: the smallest text per (start, company reached) that no shorter walk reaches."""
    if closed is not None:
        walks = walks.join(closed, "start", "left_anti")
    longer = walks.join(steps, "at").filter("next <> start").select("start", F.col("next").alias("at"), text.alias("path"))
    for known in shorter:
        longer = longer.join(known.select("start", "at"), ["start", "at"], "left_anti")
    return cut_lineage(longer.groupBy("start", "at").agg(F.min("path").alias("path")))


def circular_control(
    company_controllers: DataFrame, *, max_depth: int = 6, limit: int | None = None
) -> DataFrame:
    """Companies that control themselves through a chain of at most ``max_depth`` companies.

    The result is the shortest cycle per company, the smallest path text among
    equally short ones. Walks of half the depth go up from every company and down to it,
    and a cycle is where the two meet: both halves of a shortest cycle are shortest
    walks, and of two equally short walks between two companies the smaller text stays
    smaller whatever surrounds it. So one path per (company, company reached) is
    kept, and none of more than half the depth. Companies that have found their
    cycle go no further. Edges into companies that control nothing, or out of
    companies nothing is controlled by, are pruned beforehand.
    """
    checks.integer("max_depth", max_depth, 1, 12)
    checks.row_limit(limit)

    edges = (
        company_controllers.filter(
            "controller_company_id IS NOT NULL AND ceased_on IS NULL AND company_id IS NOT NULL"
        )
        .select(F.col("company_id").alias("child"), F.col("controller_company_id").alias("parent"))
        .distinct()
    )
    found = edges.filter("child = parent").select(
        F.col("child").alias("start"),
        F.lit(1).alias("cycle_length"),
        F.concat_ws(" > ", "child", "parent").alias("cycle_path"),
    )
    # A company outside every cycle is pruned when one side of it is bare. Pruning only saves
    # work: a fixed number of rounds takes the loose ends off.
    core = cut_lineage(edges.filter("child <> parent"))
    for _ in range(PRUNING_ROUNDS):
        controlled = core.select(F.col("child").alias("parent")).distinct()
        controlling = core.select(F.col("parent").alias("child")).distinct()
        core = cut_lineage(core.join(controlled, "parent", "left_semi").join(controlling, "child", "left_semi"))

    upwards = core.select(F.col("child").alias("at"), F.col("parent").alias("next"))
    downwards = core.select(F.col("parent").alias("at"), F.col("child").alias("next"))
    # By length: walks from start up to ``at``, and what follows ``at`` on the way up to start.
    ahead = [core.select(F.col("child").alias("start"), F.col("parent").alias("at"), F.concat_ws(" > ", "child", "parent").alias("path"))]
    behind = [core.select(F.col("parent").alias("start"), F.col("child").alias("at"), F.col("parent").alias("path"))]
    closed = found.select("start")
    for length in range(2, max_depth + 1):
        half, rest = (length + 1) // 2, length // 2
        if len(ahead) < half:
            ahead.append(_further(ahead[-1], ahead, upwards, closed, F.concat_ws(" > ", "path", "next")))
            if ahead[-1].isEmpty():
                break
        if len(behind) < rest:
            behind.append(_further(behind[-1], behind, downwards, closed, F.concat_ws(" > ", "at", "path")))
        up, down = ahead[half - 1], behind[rest - 1].withColumnRenamed("path", "_after")
        met = up.join(down, ["start", "at"]).groupBy("start").agg(F.min(F.concat_ws(" > ", "path", "_after")).alias("cycle_path"))
        now = met.select("start", F.lit(length).alias("cycle_length"), "cycle_path")
        if length <= max_depth - 2:  # longer walks follow: they start from open companies only
            now = cut_lineage(now)
            closed = closed.unionByName(now.select("start")).distinct()
        found = found.unionByName(now)

    shortest = found.groupBy("start").agg(F.min(F.struct("cycle_length", "cycle_path")).alias("_cycle"))
    return top(
        shortest.select(
            F.col("start").alias("candidate_id"), F.col("start").alias("company_id"), "_cycle.cycle_length", "_cycle.cycle_path"
        ),
        [F.col("cycle_length"), F.col("candidate_id")],
        limit,
    )


def frequent_name_changes(companies: DataFrame, *, min_previous_names: int = 6, limit: int | None = None) -> DataFrame:
    """Companies that changed their registered name many times."""
    checks.integer("min_previous_names", min_previous_names, 1, 1000)
    checks.row_limit(limit)
    renamed = companies.filter(F.col("previous_name_count") >= min_previous_names)
    return top(
        first_per_key(
            renamed,
            ["company_id"],
            [F.col("previous_name_count").desc(), F.col("name").asc_nulls_last(), *_rest(companies)],
        ).select(
            F.col("company_id").alias("candidate_id"),
            "company_id",
            "name",
            "jurisdiction",
            "previous_name_count",
            "incorporation_date",
            "status",
            "source_url",
        ),
        [F.col("previous_name_count").desc(), F.col("candidate_id").asc_nulls_last()],
        limit,
    )


def _rest(df: DataFrame) -> list:
    """Every column, as a last tie-break that makes the chosen row deterministic."""
    return [F.col(name).asc_nulls_last() for name in df.columns]


def prolific_officer(
    company_officers: DataFrame,
    company_controllers: DataFrame,
    *,
    min_companies: int = 100,
    exclude_roles: str = "REVI|REGN",
    limit: int | None = None,
) -> DataFrame:
    """Officers or controllers with current positions in many companies."""
    checks.integer("min_companies", min_companies, 2, 1_000_000)
    checks.text("exclude_roles", exclude_roles, 500)
    checks.row_limit(limit)
    excluded = split_list(exclude_roles.upper())
    officers = company_officers.filter("resigned_on IS NULL AND officer_id IS NOT NULL")
    if excluded:
        officers = officers.filter(~upper_trim(F.coalesce("role", F.lit(""))).isin(*excluded))
    holders = officers.select(
        F.lit("officer").alias("holder_type"),
        F.col("officer_id").alias("holder_id"),
        "name",
        "company_id",
        F.coalesce("company_name", "company_id").alias("company_label"),
    ).unionByName(
        company_controllers.filter(
            "ceased_on IS NULL AND controller_id IS NOT NULL AND controller_kind <> 'statement'"
        ).select(
            F.lit("controller").alias("holder_type"),
            F.col("controller_id").alias("holder_id"),
            F.col("controller_name").alias("name"),
            "company_id",
            F.col("company_id").alias("company_label"),
        )
    )
    keys = ["holder_type", "holder_id"]
    order = [F.col("companies").desc(), F.col("candidate_id")]
    leads = top(
        holders.groupBy(*keys)
        .agg(F.min("name").alias("name"), F.count_distinct("company_id").alias("companies"))
        .filter(F.col("companies") >= min_companies)
        .select(F.concat_ws("|", *keys).alias("candidate_id"), *keys, "name", "companies"),
        order,
        limit,
    )
    return with_joined_list(
        leads, holders, keys, "company_label", "example_companies", separator="|", first=5
    ).transform(in_order(order, limit))


def rapid_dissolution(companies: DataFrame, *, max_days: int = 365, limit: int | None = None) -> DataFrame:
    """Companies dissolved soon after incorporation."""
    checks.integer("max_days", max_days, 0, 3650)
    checks.row_limit(limit)
    days = F.datediff("dissolution_date", "incorporation_date")
    short_lived = companies.filter(days.between(0, max_days))
    return top(
        first_per_key(
            short_lived,
            ["company_id"],
            [F.col("dissolution_date"), F.col("name").asc_nulls_last(), *_rest(companies)],
        ).select(
            F.col("company_id").alias("candidate_id"),
            "company_id",
            "name",
            "jurisdiction",
            "incorporation_date",
            "dissolution_date",
            days.cast("long").alias("days_existed"),
            "registered_address",
            "source_url",
        ),
        [F.col("days_existed"), F.col("candidate_id").asc_nulls_last()],
        limit,
    )


def secrecy_jurisdiction_controller(
    company_controllers: DataFrame,
    companies: DataFrame,
    *,
    jurisdictions: str = SECRECY_JURISDICTIONS,
    limit: int | None = None,
) -> DataFrame:
    """Companies controlled by a legal entity from another, secretive country."""
    checks.text("jurisdictions", jurisdictions, 1000)
    checks.row_limit(limit)
    country = upper_trim("controller_country")
    controllers = company_controllers.filter(
        (F.col("controller_kind") == "legal_entity")
        & F.col("ceased_on").isNull()
        & country.isin(*split_list(jurisdictions.upper()))
    )
    home = companies.groupBy("company_id").agg(
        F.min("name").alias("company_name"), F.min(upper_trim("jurisdiction")).alias("home")
    )
    id_prefix = F.when(
        ~F.col("company_id").startswith("lei:"), F.upper(F.split_part("company_id", F.lit(":"), F.lit(1)))
    )
    flagged = (
        controllers.join(home, "company_id", "left")
        .select(
            "company_id",
            "company_name",
            F.coalesce("home", id_prefix).alias("company_jurisdiction"),
            "controller_id",
            "controller_name",
            country.alias("controller_country"),
            "controller_company_id",
            "control_type",
            "notified_on",
        )
        .filter(~F.col("company_jurisdiction").eqNullSafe(F.col("controller_country")))
    )
    one_each = first_per_key(
        flagged, ["company_id", "controller_id"], [F.col("control_type").asc_nulls_last(), *_rest(flagged)]
    )
    return top(
        one_each.select(
            F.concat("company_id", F.lit("|"), "controller_id").alias("candidate_id"),
            *flagged.columns,
        ),
        [F.col("controller_country"), F.col("candidate_id").asc_nulls_last()],
        limit,
    )


def shared_registered_address(companies: DataFrame, *, min_companies: int = 50, limit: int | None = None) -> DataFrame:
    """Addresses at which many companies are registered, whatever the spelling."""
    checks.integer("min_companies", min_companies, 2, 1_000_000)
    checks.row_limit(limit)
    keyed = companies.select(
        "company_id",
        "name",
        F.upper("jurisdiction").alias("jurisdiction"),
        "registered_address",
        "incorporation_date",
        F.when(F.col("dissolution_date").isNull(), F.col("company_id")).alias("current_id"),
        address_key("registered_address").alias("address_key"),
    ).filter("address_key <> ''")
    # company_id first: the key with a third of all companies is spread over its companies.
    per_company = keyed.groupBy("address_key", "company_id").agg(
        F.max(F.col("current_id").isNotNull()).alias("is_current"),
        F.min("registered_address").alias("registered_address"),
        F.min("incorporation_date").alias("first_incorporated"),
        F.max("incorporation_date").alias("last_incorporated"),
    )
    leads = (
        per_company.groupBy("address_key")
        .agg(
            F.min("registered_address").alias("registered_address"),
            F.count("company_id").alias("companies"),
            F.count(F.when(F.col("is_current") & F.col("company_id").isNotNull(), F.lit(1))).alias("current_companies"),
            F.min("first_incorporated").alias("first_incorporated"),
            F.max("last_incorporated").alias("last_incorporated"),
        )
        .filter(F.col("companies") >= min_companies)
        .withColumnRenamed("address_key", "candidate_id")
    )
    order = [F.col("companies").desc(), F.col("candidate_id")]
    leads = top(leads, order, limit)
    source = keyed.withColumnRenamed("address_key", "candidate_id")
    leads = with_joined_list(leads, source, ["candidate_id"], "jurisdiction", "jurisdictions", separator="|")
    leads = with_joined_list(leads, source, ["candidate_id"], "name", "example_companies", separator="|", first=5)
    return leads.select(
        "candidate_id",
        "registered_address",
        "companies",
        "current_companies",
        "jurisdictions",
        "first_incorporated",
        "last_incorporated",
        "example_companies",
    ).transform(in_order(order, limit))
