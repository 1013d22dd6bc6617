"""US legislators and press releases; US and UK donations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.sources.landed.common import as_contract, day, joined, money, text

LEGISLATOR = """
    id struct<bioguide:string>, name struct<official_full:string,first:string,last:string>,
    terms array<struct<type:string,party:string,state:string>>
"""
COMMITTEE = "thomas_id string, name string, subcommittees array<struct<thomas_id:string,name:string>>"
COMMITTEE_MEMBERS = "map<string,array<struct<bioguide:string,title:string>>>"
PRESS_RELEASE = "member struct<bioguide_id:string,name:string>, date string, text string, title string, url string"


def legislators(people: DataFrame) -> DataFrame:
    """Party and state of the last term."""
    term = F.try_element_at("terms", F.lit(-1))
    full = F.nullif(F.col("name.official_full"), F.lit(""))
    return as_contract(
        people.select(
            F.col("id.bioguide").alias("bioguide_id"),
            F.coalesce(full, joined("name.first", "name.last"), F.lit("")).alias("name"),
            term["party"].alias("party"),
            term["state"].alias("state"),
        ),
        "legislators",
    )


def committee_assignments(memberships: DataFrame, committees: DataFrame) -> DataFrame:
    """Members per committee; ``memberships`` has one JSON object in ``value``, committee id to members.

    A subcommittee's id is its parent's id and its own; unknown ids keep the id as name.
    """
    subs = committees.select(
        F.col("thomas_id").alias("parent_id"), F.col("name").alias("parent"), F.explode("subcommittees").alias("s")
    ).select(
        F.concat("parent_id", "s.thomas_id").alias("committee_id"),
        F.concat("parent", F.lit(": "), "s.name").alias("committee"),
    )
    names = committees.select(F.col("thomas_id").alias("committee_id"), F.col("name").alias("committee")).unionByName(subs)
    listed = memberships.select(F.explode(F.from_json("value", COMMITTEE_MEMBERS)).alias("committee_id", "members"))
    members = listed.select("committee_id", F.explode("members").alias("m"))
    return as_contract(
        members.join(names, "committee_id", "left").select(
            F.col("m.bioguide").alias("bioguide_id"),
            F.coalesce("committee", "committee_id").alias("committee_name"),
            F.coalesce(F.nullif(F.col("m.title"), F.lit("")), F.lit("Member")).alias("role"),
        ),
        "committee_assignments",
    )


def press_releases(releases: DataFrame) -> DataFrame:
    return as_contract(
        releases.select(
            F.col("member.bioguide_id").alias("bioguide_id"),
            "date",
            F.col("member.name").alias("member_name"),
            "text",
            "title",
            "url",
        ),
        "press_releases",
    )


US_RECEIPT = """
    sub_id string, committee_id string, committee_name string, recipient_committee_type string,
    committee struct<name:string,committee_type_full:string>, contributor_name string, entity_type string,
    entity_type_desc string, contributor_employer string, contributor_zip string,
    contribution_receipt_amount double, contribution_receipt_date string
"""
US_COMMITTEE = "committee_id string, name string, first_f1_date string, first_file_date string"


def _first(*names: str):
    return F.coalesce(*[F.nullif(F.col(name), F.lit("")) for name in names])


def us_donations(receipts: DataFrame) -> DataFrame:
    return as_contract(
        receipts.select(
            F.col("sub_id").alias("donation_id"),
            F.col("committee_id").alias("recipient_id"),
            _first("committee_name", "committee.name").alias("recipient_name"),
            _first("committee.committee_type_full", "recipient_committee_type").alias("recipient_type"),
            F.col("contributor_name").alias("donor_name"),
            _first("entity_type_desc", "entity_type").alias("donor_type"),
            F.col("contributor_employer").alias("donor_employer"),
            F.col("contributor_zip").alias("donor_postcode"),
            F.col("contribution_receipt_amount").alias("amount"),
            F.lit("USD").alias("currency"),
            day("contribution_receipt_date").alias("donation_date"),
        ),
        "donations",
    )


def us_recipients(committees: DataFrame) -> DataFrame:
    """Registered on the date of the first statement of organisation."""
    return as_contract(
        committees.select(
            F.col("committee_id").alias("recipient_id"),
            "name",
            day(_first("first_f1_date", "first_file_date")).alias("registered_date"),
        ),
        "recipients",
    )


def _uk_date(name: str):
    return F.to_date(text(name), "dd/MM/yyyy")


def uk_donations(rows: DataFrame) -> DataFrame:
    """Donations as published in CSV: day first dates, pounds with commas."""
    return as_contract(
        rows.select(
            text("ECRef").alias("donation_id"),
            text("RegulatedEntityId").alias("recipient_id"),
            text("RegulatedEntityName").alias("recipient_name"),
            text("RegulatedEntityType").alias("recipient_type"),
            text("DonorName").alias("donor_name"),
            text("DonorStatus").alias("donor_type"),
            text("CompanyRegistrationNumber").alias("donor_company_number"),
            text("Postcode").alias("donor_postcode"),
            money("Value").alias("amount"),
            F.lit("GBP").alias("currency"),
            F.coalesce(_uk_date("ReceivedDate"), _uk_date("AcceptedDate")).alias("donation_date"),
        ),
        "donations",
    )


def uk_recipients(rows: DataFrame) -> DataFrame:
    """Registrations; the digits of the reference are the id that donations use."""
    return as_contract(
        rows.select(
            F.nullif(F.regexp_replace(text("ECRef"), "^[A-Z]+", ""), F.lit("")).alias("recipient_id"),
            text("RegulatedEntityName").alias("name"),
            _uk_date("ApprovedDate").alias("registered_date"),
        ),
        "recipients",
    )
