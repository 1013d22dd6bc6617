"""Court docket and judicial disclosure detectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions import checks
from leadspark.functions.relational import dealt_join, in_order, top
from leadspark.functions.text import decimal_round, name_key, word_prefixes
from leadspark.session import cut_lineage

# Fixed value: parties that appear in so many cases that they say nothing.
GOVERNMENT_PARTIES = (
    "^(UNITED STATES|USA|U S A|STATE OF|COMMISSIONER OF SOCIAL SECURITY|SOCIAL SECURITY ADMINISTRATION)( |$)"
)

# Fixed value: so many gifts of a name in one list, or few more.
_LISTED_GIFTS = 1024


def _cases(court_cases: DataFrame, **columns: Column) -> DataFrame:
    """One row per case, whatever number of docket rows describe it."""
    return court_cases.groupBy("case_id").agg(*[value.alias(name) for name, value in columns.items()])


def _keyed(rows: DataFrame, name: str, key: str, min_name_length: int) -> DataFrame:
    """The distinct texts of column ``name`` as ``_name``, with their name key if that is long enough to match."""
    names = rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("_rows"))
    # The count keeps the key above the grouping: the optimizer would filter by it, and so work it out, on every row.
    return names.select("_name", F.when(F.col("_rows") > 0, name_key("_name")).alias(key)).filter(F.length(key) >= min_name_length)


def _matched_names(
    cases: DataFrame, names: DataFrame, name: str, interests: DataFrame, interest: str, min_name_length: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names of a case that equal, start or continue a name on its judge's disclosure.

    "One name is the other plus more words" becomes two equalities: a word
    prefix of the case name equals the disclosed name (A), or a proper word
    prefix of the disclosed name equals the case name (B). Both run in one hash
    join on distinct keys alone: first on (key, A or B), so that names that no
    judge discloses leave before their case is looked up, then on (judge, key, A or B),
    so that the names of a judge are never paired with all interests of that judge.
    Cases and interests are joined to the pairs of keys that match. Returned are the sides of a join on
    (judge, name key), which gives as many rows as cases times fitting interests, and how many those are.
    """

    def marked(keys: Column, side: str) -> Column:
        return F.transform(keys, lambda key: F.struct(key.alias("key"), F.lit(side).alias("side")))

    name_key_column, interest_key_column = F.col("name_key"), F.col("interest_key")
    proper_prefixes = F.filter(word_prefixes(interest_key_column), lambda key: key != interest_key_column)
    of_name = F.explode(F.concat(marked(word_prefixes(name_key_column), "A"), marked(F.array(name_key_column), "B")))
    of_interest = F.explode(F.concat(marked(F.array(interest_key_column), "A"), marked(proper_prefixes, "B")))

    listed = _keyed(interests, interest, "interest_key", min_name_length)
    known = _keyed(names, name, "name_key", min_name_length).withColumn("_key", of_name)
    known = cut_lineage(
        known.join(listed.select(of_interest.alias("_key")), "_key", "left_semi").select("_name", "name_key").distinct()
    )
    # A frequent name is split by adaptive execution: the other side has one row for it.
    matched = names.join(known, F.col(name) == F.col("_name")).drop("_name").distinct().join(cases, "case_id")
    listed = interests.join(listed, F.col(interest) == F.col("_name")).drop("_name")
    heard = matched.groupBy("judge_id", "name_key").agg(F.count(F.lit(1)).alias("_names"))
    disclosed = listed.groupBy("judge_id", "interest_key").agg(F.count(F.lit(1)).alias("_interests"))
    # Equal keys meet by A and by their whole name, so pairs are made distinct.
    pairs = heard.withColumn("_key", of_name).join(disclosed.withColumn("_key", of_interest), ["judge_id", "_key"]).drop("_key")
    pairs = pairs.withColumn("match_type", F.when(F.col("interest_key") == F.col("name_key"), "exact").otherwise("prefix"))
    pairs = cut_lineage(pairs.distinct())
    sizes = pairs.groupBy("judge_id", "name_key").agg(F.sum(F.col("_names").cast("double") * F.col("_interests")).alias("pairs"))
    return matched, listed.join(pairs.drop("_names"), ["judge_id", "interest_key"]), sizes


def _with_years(cases: DataFrame, year_slack: int) -> DataFrame:
    """The years of a case with some slack, worked out before it meets its reports."""
    return cases.withColumn("_first_year", F.year("date_filed") - year_slack).withColumn(
        "_last_year", F.year("date_terminated") + year_slack
    )


def _around(report_year: Column) -> Column:
    """Whether a report is of the years of the case."""
    return (report_year >= F.col("_first_year")) & (F.col("_last_year").isNull() | (report_year <= F.col("_last_year")))


def gift_from_litigant_or_counsel(
    court_cases: DataFrame,
    case_parties: DataFrame,
    case_counsel: DataFrame,
    judge_interests: DataFrame,
    *,
    min_name_length: int = 4,
    year_slack: int = 2,
    amounts: Callable[[Column], Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Gifts or paid trips from a party, counsel or law firm in a case of the receiving judge.

    ``amounts`` shapes both values of a gift (rounds them, say) once for each gift, not for each of its leads.
    """
    checks.integer("min_name_length", min_name_length, 1, 50)
    checks.integer("year_slack", year_slack, 0, 10)
    checks.row_limit(limit)
    cases = _cases(
        court_cases.filter("assigned_judge_id IS NOT NULL AND date_filed IS NOT NULL"),
        court_id=F.min("court_id"),
        case_name=F.min("case_name"),
        date_filed=F.min("date_filed"),
        date_terminated=F.max("date_terminated"),
        judge_id=F.min("assigned_judge_id"),
        judge_name=F.min("assigned_judge_name"),
        url=F.min("url"),
    )
    named = (
        case_parties.select("case_id", F.col("party_name").alias("matched_name"), F.lit("party").alias("matched_as"))
        .unionByName(
            case_counsel.select(
                "case_id", F.col("counsel_name").alias("matched_name"), F.lit("counsel").alias("matched_as")
            )
        )
        .unionByName(
            case_counsel.filter("firm_name IS NOT NULL").select(
                "case_id", F.col("firm_name").alias("matched_name"), F.lit("firm").alias("matched_as")
            )
        )
    )
    interest = F.lower("interest_type")
    benefits = judge_interests.filter(interest.isin("gift", "reimbursement") & F.col("report_year").isNotNull()).select(
        "judge_id",
        "report_year",
        interest.alias("interest_type"),
        F.col("counterparty").alias("benefit_source"),
        F.col("description").alias("benefit_description"),
        "value_low",
        "value_high",
        F.col("url").alias("report_url"),
    ).distinct()
    cases = _with_years(cases, year_slack)
    matched, fitting, sizes = _matched_names(cases, named, "matched_name", benefits, "benefit_source", min_name_length)
    if amounts is not None:
        fitting = fitting.withColumns({value: amounts(F.col(value)) for value in ("value_low", "value_high")})
    # A case meets a name's gifts of a year as lists. Gifts that differ in their link alone stand together in them and the
    # rows of a case follow each other, so that a file of leads holds what they repeat once.
    gift = ["interest_type", "benefit_description", "value_low", "value_high", "benefit_source", "report_url"]
    piece = F.pmod(F.hash(*gift), F.ceil(F.col("_interests") / _LISTED_GIFTS))
    lists = fitting.groupBy("judge_id", "name_key", "match_type", "report_year", piece.alias("_piece")).agg(
        F.array_sort(F.collect_list(F.struct(*gift))).alias("_gifts")
    )
    matches = dealt_join(matched, lists.drop("_piece"), ["judge_id", "name_key"], "case_id", sizes)
    matches = matches.filter(_around(F.col("report_year"))).select("*", F.inline("_gifts"))
    columns = [
        "case_id", "court_id", "case_name", "date_filed", "date_terminated", "judge_id", "judge_name",
        "matched_name", "matched_as", "interest_type", "benefit_source", "benefit_description", "report_year",
        "value_low", "value_high", "match_type", "report_url", "url",
    ]
    order = ["match_type", "date_filed", "case_id", "matched_name", "report_year", "benefit_source"]
    # Names per case and interests are distinct and cases unique, so no match occurs twice.
    return top(
        matches.select(*columns),
        [F.col(name).asc_nulls_last() for name in [*order, *[name for name in columns if name not in order]]],
        limit,
    )


def judge_holds_party_stock(
    court_cases: DataFrame,
    case_parties: DataFrame,
    judge_interests: DataFrame,
    *,
    min_name_length: int = 4,
    year_slack: int = 1,
    limit: int | None = None,
) -> DataFrame:
    """Cases of a judge who discloses an investment in a party around the years of the case."""
    checks.integer("min_name_length", min_name_length, 1, 50)
    checks.integer("year_slack", year_slack, 0, 5)
    checks.row_limit(limit)
    cases = _cases(
        court_cases.filter("assigned_judge_id IS NOT NULL AND date_filed IS NOT NULL"),
        court_id=F.min("court_id"),
        case_name=F.min("case_name"),
        docket_number=F.min("docket_number"),
        date_filed=F.min("date_filed"),
        date_terminated=F.max("date_terminated"),
        judge_id=F.min("assigned_judge_id"),
        judge_name=F.min("assigned_judge_name"),
        url=F.min("url"),
    )
    parties = case_parties.select("case_id", "party_name", "party_role")
    # The report rows of one year say the same; only bounds and one link are reported. A holding's years are one row,
    # so a case and party meet it once and nothing of theirs is grouped again.
    holdings = (
        judge_interests.filter((F.lower("interest_type") == "investment") & F.col("report_year").isNotNull())
        .groupBy("judge_id", "report_year", F.col("counterparty").alias("holding"))
        .agg(
            F.max("value_low").alias("value_low"),
            F.max("value_high").alias("value_high"),
            F.min("url").alias("report_url"),
        )
        .groupBy("judge_id", "holding")
        .agg(F.collect_list(F.struct("report_year", "value_low", "value_high", "report_url")).alias("reports"))
    )
    around = F.filter("reports", lambda report: _around(report["report_year"]))
    cases = _with_years(cases, year_slack)
    matched, fitting, sizes = _matched_names(cases, parties, "party_name", holdings, "holding", min_name_length)
    matches = dealt_join(matched, fitting.drop("_interests"), ["judge_id", "name_key"], "case_id", sizes)
    matches = matches.withColumn("reports", around).filter("size(reports) > 0")
    keys = [
        "case_id", "court_id", "case_name", "docket_number", "date_filed", "date_terminated", "judge_id",
        "judge_name", "party_name", "party_role", "holding", "match_type",
    ]
    leads = matches.select(
        *keys,
        F.array_min("reports.report_year").alias("first_report_year"),
        F.array_max("reports.report_year").alias("last_report_year"),
        F.array_max("reports.value_low").alias("max_value_low"),
        F.array_max("reports.value_high").alias("max_value_high"),
        F.array_min("reports.report_url").alias("report_url"),
        "url",
    )
    return top(
        leads,
        [
            F.col("match_type"),
            F.col("max_value_low").desc_nulls_last(),
            F.col("date_filed"),
            F.col("case_id").asc_nulls_last(),
            F.col("party_name").asc_nulls_last(),
            F.col("holding").asc_nulls_last(),
            F.col("party_role").asc_nulls_last(),
        ],
        limit,
    )


def long_pending_cases(
    court_cases: DataFrame,
    *,
    min_years: float = 3,
    as_of_date: str = "",
    civil_only: int = 1,
    limit: int | None = None,
) -> DataFrame:
    """Cases still open many years after filing, with the number of them per judge."""
    checks.number("min_years", min_years, 0, 100)
    checks.text("as_of_date", as_of_date, 10)
    checks.integer("civil_only", civil_only, 0, 1)
    checks.row_limit(limit)
    dated = court_cases.filter("date_filed IS NOT NULL")
    cases = _cases(
        dated,
        court_id=F.min("court_id"),
        case_name=F.min("case_name"),
        docket_number=F.min("docket_number"),
        nature_of_suit=F.min("nature_of_suit"),
        judge_id=F.min("assigned_judge_id"),
        judge_name=F.min("assigned_judge_name"),
        date_filed=F.min("date_filed"),
        date_terminated=F.max("date_terminated"),
        url=F.min("url"),
    )
    if as_of_date:
        as_of = F.lit(as_of_date).cast("date")
    else:
        # Latest date over one value per case: the later of first filing and last termination.
        per_case = _cases(dated, filed=F.min("date_filed"), ended=F.max("date_terminated"))
        as_of = per_case.agg(F.max(F.greatest("filed", "ended")).alias("as_of")).scalar()
    age = F.datediff("as_of_date", "date_filed") / F.lit(365.25)
    pending = cases.withColumn("as_of_date", as_of).filter(
        (F.col("date_filed") <= F.col("as_of_date"))
        & (F.col("date_terminated").isNull() | (F.col("date_terminated") > F.col("as_of_date")))
        & (age > float(min_years))
    )
    if civil_only:
        pending = pending.filter("nature_of_suit IS NOT NULL")
    pending = pending.withColumn("years_pending", decimal_round(age, 2))
    order = [F.col("years_pending").desc(), F.col("case_id").asc_nulls_last()]
    per_judge = pending.groupBy(F.col("court_id").alias("_court"), F.col("judge_id").alias("_judge")).agg(
        F.count(F.lit(1)).alias("judge_long_pending")
    )
    leads = top(pending, order, limit)
    same_judge = F.col("court_id").eqNullSafe(F.col("_court")) & F.col("judge_id").eqNullSafe(F.col("_judge"))
    return (
        leads.join(per_judge, same_judge)
        .select(
            "case_id", "court_id", "case_name", "docket_number", "nature_of_suit", "judge_id", "judge_name",
            "date_filed", "as_of_date", "years_pending", "judge_long_pending", "url",
        )
        .transform(in_order(order, limit))
    )


def repeat_party_before_judge(
    court_cases: DataFrame,
    case_parties: DataFrame,
    *,
    min_cases: int = 3,
    min_share: float = 0.75,
    party_role: str = "plaintiff",
    exclude_pattern: str = GOVERNMENT_PARTIES,
    limit: int | None = None,
) -> DataFrame:
    """Parties whose cases in a court nearly all went to one judge."""
    checks.integer("min_cases", min_cases, 2, 100_000)
    checks.number("min_share", min_share, 0, 1)
    checks.text("party_role", party_role, 50)
    checks.text("exclude_pattern", exclude_pattern, 500)
    checks.row_limit(limit)
    cases = _cases(
        court_cases.filter("assigned_judge_id IS NOT NULL"),
        court_id=F.min("court_id"),
        judge_id=F.min("assigned_judge_id"),
        judge_name=F.min("assigned_judge_name"),
        date_filed=F.min("date_filed"),
    )
    parties = case_parties
    if party_role:
        role = F.col("party_role")
        parties = parties.filter(role.isNull() | (F.lower(role) == party_role.lower()))
    key = name_key("party_name")
    parties = parties.select("case_id", "party_name", key.alias("party_key")).filter("party_key <> ''")
    if exclude_pattern:
        parties = parties.filter(~F.col("party_key").rlike(exclude_pattern))
    # One row per case and party, so counting rows counts cases.
    appearances = parties.groupBy("case_id", "party_key").agg(F.min("party_name").alias("party_name")).join(
        cases.filter("court_id IS NOT NULL"), "case_id"
    )
    per_judge = appearances.groupBy("party_key", "court_id", "judge_id").agg(
        F.min("judge_name").alias("judge_name"),
        F.min("party_name").alias("party_name"),
        F.count(F.lit(1)).alias("cases_before_judge"),
        F.min("date_filed").alias("first_filed"),
        F.max("date_filed").alias("last_filed"),
    )
    # At most one row per judge of the court is left in this window.
    in_court = Window.partitionBy("party_key", "court_id")
    share = F.col("cases_before_judge") / F.col("party_cases")
    repeated = (
        per_judge.withColumn("party_cases", F.sum("cases_before_judge").over(in_court))
        .filter((F.col("party_cases") >= min_cases) & (share >= float(min_share)))
        .withColumn("judge_share", decimal_round(share, 4))
    )
    judges = cases.groupBy("court_id").agg(F.count_distinct("judge_id").alias("judges_in_court"))
    return top(
        repeated.join(judges, "court_id").select(
            "party_name", "court_id", "judge_id", "judge_name", "cases_before_judge", "party_cases", "judge_share",
            "judges_in_court", "first_filed", "last_filed",
        ),
        [
            F.col("cases_before_judge").desc(),
            F.col("judge_share").desc(),
            F.col("court_id"),
            F.col("party_name"),
            F.col("judge_id"),
        ],
        limit,
    )


def single_judge_concentration(
    court_cases: DataFrame, *, min_cases: int = 10, min_share: float = 0.9, limit: int | None = None
) -> DataFrame:
    """Courts or divisions in which one judge gets nearly all cases of one kind."""
    checks.integer("min_cases", min_cases, 1, 1_000_000)
    checks.number("min_share", min_share, 0, 1)
    checks.row_limit(limit)
    cases = _cases(
        court_cases.filter("assigned_judge_id IS NOT NULL"),
        court_id=F.min("court_id"),
        division_key=F.coalesce(F.min("division"), F.lit("")),
        nature_key=F.coalesce(F.min("nature_of_suit"), F.lit("")),
        judge_id=F.min("assigned_judge_id"),
        judge_name=F.min("assigned_judge_name"),
        date_filed=F.min("date_filed"),
    ).filter("court_id IS NOT NULL")
    market = ["court_id", "division_key", "nature_key"]
    per_judge = cases.groupBy(*market, "judge_id").agg(
        F.min("judge_name").alias("judge_name"),
        F.count(F.lit(1)).alias("judge_cases"),
        F.min("date_filed").alias("first_seen"),
        F.max("date_filed").alias("last_seen"),
    )
    # At most one row per judge of the market is left in this window.
    everyone = Window.partitionBy(*market)
    share = F.col("judge_cases") / F.col("total_cases")
    return top(
        per_judge.select(
            "*",
            F.sum("judge_cases").over(everyone).alias("total_cases"),
            F.count(F.lit(1)).over(everyone).alias("judges_in_market"),
            F.min("first_seen").over(everyone).alias("first_filed"),
            F.max("last_seen").over(everyone).alias("last_filed"),
        )
        .filter((F.col("total_cases") >= min_cases) & (share >= float(min_share)))
        .select(
            "court_id",
            F.nullif("division_key", F.lit("")).alias("division"),
            F.nullif("nature_key", F.lit("")).alias("nature_of_suit"),
            "judge_id",
            "judge_name",
            "judge_cases",
            "total_cases",
            decimal_round(share, 4).alias("judge_share"),
            "judges_in_market",
            "first_filed",
            "last_filed",
        ),
        [
            F.col("judge_share").desc(),
            F.col("total_cases").desc(),
            F.col("court_id"),
            F.col("division").asc_nulls_last(),
            F.col("nature_of_suit").asc_nulls_last(),
            F.col("judge_id"),
        ],
        limit,
    )
