"""Court dockets with parties and attorneys, and judges' financial disclosures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.sources.landed.common import as_contract, day, money, text

DOCKET = """
    id bigint, court_id string, case_name string, docket_number string, date_filed string, date_terminated string,
    nature_of_suit string, federal_dn_office_code string, assigned_to string, assigned_to_str string,
    absolute_url string
"""
PARTY = "docket_id bigint, name string, party_types array<struct<name:string,docket_id:bigint>>"
ATTORNEY = "docket_id bigint, name string"
SITE = "https://www.courtlistener.com"


def _resource_id(url: str) -> Column:
    """Numeric last segment of a resource URL."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), "/([0-9]+)/*$", 1), F.lit(""))


def court_cases(dockets: DataFrame) -> DataFrame:
    url = F.col("absolute_url")
    return as_contract(
        dockets.select(
            F.col("id").cast("string").alias("case_id"),
            "court_id",
            text("case_name").alias("case_name"),
            text("docket_number").alias("docket_number"),
            day("date_filed").alias("date_filed"),
            day("date_terminated").alias("date_terminated"),
            text("nature_of_suit").alias("nature_of_suit"),
            text("federal_dn_office_code").alias("division"),
            _resource_id("assigned_to").alias("assigned_judge_id"),
            text("assigned_to_str").alias("assigned_judge_name"),
            F.when(url.rlike("^https?://"), url).when(url != "", F.concat(F.lit(SITE), url)).alias("url"),
        ),
        "court_cases",
    )


def case_parties(parties: DataFrame) -> DataFrame:
    """A row per distinct role of the party in this docket, or one without a role."""
    here = F.filter(
        F.coalesce("party_types", F.array().cast("array<struct<name:string,docket_id:bigint>>")),
        lambda kind: kind["docket_id"].isNull() | (kind["docket_id"] == F.col("docket_id")),
    )
    roles = F.array_distinct(
        F.filter(
            F.transform(here, lambda kind: F.nullif(F.trim(kind["name"]), F.lit(""))), lambda role: role.isNotNull()
        )
    )
    return as_contract(
        parties.select(
            F.col("docket_id").cast("string").alias("case_id"),
            text("name").alias("party_name"),
            F.explode_outer(roles).alias("party_role"),
        ),
        "case_parties",
    )


def case_counsel(attorneys: DataFrame) -> DataFrame:
    """The source names no firm."""
    return as_contract(
        attorneys.select(F.col("docket_id").cast("string").alias("case_id"), text("name").alias("counsel_name")),
        "case_counsel",
    )


DISCLOSURE = """
    person string, year bigint, filepath string,
    investments array<struct<description:string,gross_value_code:string>>,
    gifts array<struct<source:string,description:string,value:string>>,
    reimbursements array<struct<source:string,date_raw:string,location:string,purpose:string,
        items_paid_or_provided:string>>,
    positions array<struct<organization_name:string,position:string>>,
    agreements array<struct<parties_and_terms:string,date_raw:string>>,
    non_investment_incomes array<struct<source_type:string,date_raw:string,income_amount:string>>,
    spouse_incomes array<struct<source_type:string,date_raw:string>>,
    debts array<struct<creditor_name:string,description:string,value_code:string>>
"""
# Bounds of the disclosure value codes; P4 has no upper bound.
VALUE_BOUNDS = {
    "J": (1, 15000),
    "K": (15001, 50000),
    "L": (50001, 100000),
    "M": (100001, 250000),
    "N": (250001, 500000),
    "O": (500001, 1000000),
    "P1": (1000001, 5000000),
    "P2": (5000001, 25000000),
    "P3": (25000001, 50000000),
    "P4": (50000001, None),
}


def _coded(code: Column) -> tuple[Column, Column]:
    low = high = F.lit(None).cast("double")
    for key, (least, most) in VALUE_BOUNDS.items():
        low = F.when(code == key, F.lit(float(least))).otherwise(low)
        high = F.when(code == key, F.lit(None if most is None else float(most)).cast("double")).otherwise(high)
    return low, high


def _stated(value: Column) -> tuple[Column, Column]:
    amount = money(value, "$")
    return amount, amount


def _none(_: Column) -> tuple[Column, Column]:
    missing = F.lit(None).cast("double")
    return missing, missing


def _trip(item: Column) -> Column:
    parts = [
        F.nullif(F.trim(item[name]), F.lit("")) for name in ("date_raw", "location", "purpose", "items_paid_or_provided")
    ]
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


# interest type: (array, counterparty field, description, value field, bounds of the value)
_INTERESTS: dict[str, tuple[str, str, str | Callable[[Column], Column] | None, str | None, Callable]] = {
    "investment": ("investments", "description", None, "gross_value_code", _coded),
    "gift": ("gifts", "source", "description", "value", _stated),
    "reimbursement": ("reimbursements", "source", _trip, None, _none),
    "position": ("positions", "organization_name", "position", None, _none),
    "agreement": ("agreements", "parties_and_terms", "date_raw", None, _none),
    "income": ("non_investment_incomes", "source_type", "date_raw", "income_amount", _stated),
    "spouse_income": ("spouse_incomes", "source_type", "date_raw", None, _none),
    "debt": ("debts", "creditor_name", "description", "value_code", _coded),
}


def _interest(kind: str) -> Callable[[Column], Column]:
    """Function from an array item of one kind to its row."""
    _, counterparty, description, value, bounds = _INTERESTS[kind]

    def row(item: Column) -> Column:
        low, high = bounds(item[value] if value else item)
        if description is None:
            told = F.lit(None).cast("string")
        elif callable(description):
            told = description(item)
        else:
            told = F.nullif(F.trim(item[description]), F.lit(""))
        return F.struct(
            F.lit(kind).alias("interest_type"),
            F.nullif(F.trim(item[counterparty]), F.lit("")).alias("counterparty"),
            told.alias("description"),
            low.alias("value_low"),
            high.alias("value_high"),
        )

    return row


def judge_interests(disclosures: DataFrame) -> DataFrame:
    """The eight kinds of interest of a disclosure as rows; an item without a counterparty gives none.

    All kinds become one array per report first, so the reports are read once.
    """
    empty = F.array().cast(
        "array<struct<interest_type:string,counterparty:string,description:string,value_low:double,value_high:double>>"
    )
    kinds = [
        F.coalesce(F.transform(F.col(array), _interest(kind)), empty) for kind, (array, *_) in _INTERESTS.items()
    ]
    every = disclosures.select(
        _resource_id("person").alias("judge_id"),
        F.col("year").alias("report_year"),
        F.col("filepath").alias("url"),
        F.explode(F.concat(*kinds)).alias("i"),
    )
    return as_contract(
        every.filter("i.counterparty IS NOT NULL").select("judge_id", "report_year", "url", "i.*"), "judge_interests"
    )
