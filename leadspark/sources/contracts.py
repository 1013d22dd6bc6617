"""Contract tables: the fixed columns and types the domain detectors read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of each contract table. Text unless ':type'; '?' marks an optional column.
CONTRACTS: dict[str, dict[str, str]] = {
    "campaign_finance": {
        "donations": "donation_id recipient_id recipient_name recipient_type? donor_name donor_type? "
        "donor_company_number? donor_employer? donor_postcode? amount:double currency? donation_date:date",
        "recipients": "recipient_id name registered_date:date",
    },
    "companies": {
        "companies": "company_id jurisdiction name status? incorporation_date:date? dissolution_date:date? "
        "registered_address? previous_name_count:long? source_url?",
        "company_officers": "company_id officer_id name company_name? role? appointed_on:date? resigned_on:date?",
        "company_controllers": "company_id controller_id controller_name controller_kind controller_country? "
        "controller_company_id? control_type? notified_on:date? ceased_on:date?",
    },
    "court": {
        "court_cases": "case_id court_id case_name docket_number? date_filed:date date_terminated:date? "
        "nature_of_suit? division? assigned_judge_id? assigned_judge_name? url?",
        "case_parties": "case_id party_name party_role?",
        "case_counsel": "case_id counsel_name firm_name?",
        "judge_interests": "judge_id judge_name? report_year:long interest_type counterparty description? "
        "value_low:double? value_high:double? url?",
    },
    "lobbying": {
        "lobbying_registrations": "registration_id register period_start:date period_end:date? registrant_id "
        "registrant_name client_id? client_name? client_country? spend_low:double? spend_high:double? issue_area? "
        "filing_type? url? client_description? client_ppb_country? posted_by_name?",
        "lobbyists": "registration_id lobbyist_id name former_public_office? former_office_institution? "
        "former_office_end:date?",
        "lobbying_contacts": "contact_id registrant_id registrant_name? contact_date:date official_name "
        "official_title? institution subject?",
        "lobbying_foreign_entities": "registration_id foreign_entity_name country ppb_country",
        "lobbying_activities": "registration_id general_issue_code description activity_index:long",
        "political_contributions": "registration_id payee_name honoree_name amount:double contributor_name",
        "foreign_agent_registrants": "registrant_name",
        "legislators": "bioguide_id name party state",
        "committee_assignments": "bioguide_id committee_name role",
        "press_releases": "bioguide_id date:date member_name text title url",
    },
    "parliamentary": {
        "parl_members": "member_id parliament name country?",
        "parl_affiliations": "member_id parliament affiliation_type org_name start_date:date end_date:date? term?",
        "parl_votings": "voting_id parliament chamber? vote_date:date title? dossier_id? url?",
        "parl_member_votes": "voting_id parliament member_id position group_at_vote?",
        "parl_interests": "interest_id member_id parliament organisation role? paid? income_high:double? end_date:date?",
    },
    "procurement": {
        "procurement_processes": "process_id buyer_id buyer_name country category_code? procurement_method? "
        "tender_value:double? currency? tender_published_date:date? tender_deadline:date? number_of_tenderers:long?",
        "procurement_awards": "award_id process_id supplier_id supplier_name award_value:double currency? "
        "award_date:date final_value:double?",
    },
}

_TYPES = {"double": T.DoubleType(), "long": T.LongType(), "date": T.DateType()}


class ContractError(ValueError):
    """The supplied table does not fit the contract."""


def domain_of(table: str) -> str:
    for domain, tables in CONTRACTS.items():
        if table in tables:
            return domain
    raise ContractError(f"no contract table named {table}")


def contract_schema(table: str) -> T.StructType:
    """Schema of a contract table; every field carries ``metadata["optional"]``."""
    fields = []
    for item in CONTRACTS[domain_of(table)][table].split():
        optional = item.endswith("?")
        name, _, kind = item.rstrip("?").partition(":")
        fields.append(T.StructField(name, _TYPES.get(kind, T.StringType()), True, {"optional": optional}))
    return T.StructType(fields)


def load_contract(df: DataFrame, table: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Project, rename and cast a table to its contract.

    ``columns`` maps contract columns to the table's own. Only contract columns
    are kept, so column pruning reaches the file. An optional column that is
    missing becomes NULL; missing required columns are an error before any job
    runs, and a value that cannot be cast fails the job (ANSI casts).
    """
    schema = contract_schema(table)
    mapping = dict(columns or {})
    unknown = sorted(set(mapping) - set(schema.names))
    if unknown:
        raise ContractError(f"columns for {table} name no contract column: {unknown}")
    source = {field.name: mapping.get(field.name, field.name) for field in schema}
    present = set(df.columns)
    missing = [
        source[field.name]
        for field in schema
        if source[field.name] not in present and not field.metadata["optional"]
    ]
    if missing:
        raise ContractError(f"{table} lacks contract columns: {sorted(missing)}")
    return df.select(
        *[
            (F.col(f"`{source[field.name]}`") if source[field.name] in present else F.lit(None))
            .cast(field.dataType)
            .alias(field.name)
            for field in schema
        ]
    )


def map_roles(df: DataFrame, required: list[str], fields: Mapping[str, str]) -> DataFrame:
    """Rename the caller's columns to the roles a statistical detector reads, and keep only those."""
    unmapped = [role for role in required if role not in fields]
    if unmapped:
        raise ContractError(f"unmapped required fields: {unmapped}")
    missing = sorted({name for name in fields.values() if name not in df.columns})
    if missing:
        raise ContractError(f"mapped columns are not in the table: {missing}")
    return df.select(*[F.col(f"`{fields[role]}`").alias(role) for role in required])
