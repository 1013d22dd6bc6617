"""Landed-data jobs over raw records that Spark derives from whole test tables, with their reference SQL.

The raw records (nested filings, releases, cubes …) are shaped from the tables
first; the reference SQL reads the tables directly.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.sources.landed import companies, court, lobbying, parliament, politics, procurement, statistics
from leadspark.testbed.bindings import bind, sql_views
from leadspark.testbed.queries import Query, read, rounded


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over test tables named in braces."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{name: read(spark, sf_dir, name) for name in names})


LINES = """
    SELECT l_orderkey, array_sort(collect_list(struct(l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_returnflag AS r,
                                                      l_extendedprice AS v, l_linestatus AS f))) AS lines
    FROM {lineitem} GROUP BY l_orderkey"""


# ---------------------------------------------------------------- lobbying


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(
        spark, sf_dir,
        f"""
    SELECT CAST(o_orderkey AS STRING) AS filing_uuid, 'Q1' AS filing_type, year(o_orderdate) AS filing_year,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'first_quarter' WHEN '2-HIGH' THEN 'mid_year' WHEN '3-MEDIUM' THEN 'fourth_quarter'
                ELSE 'other' END AS filing_period,
           'u' AS filing_document_url, 'p' AS posted_by_name,
           CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS STRING) WHEN o_orderstatus = 'O' THEN '' END AS income,
           CASE WHEN o_orderstatus <> 'P' THEN '77.5' END AS expenses,
           named_struct('id', CAST(o_custkey AS STRING), 'name', 'R') AS registrant,
           named_struct('id', CAST(o_custkey % 9 AS STRING), 'name', 'C', 'country', ' FR ', 'ppb_country', '',
                        'client_self_select', o_custkey % 5 = 0, 'general_description', ' d ') AS client,
           transform(lines, x -> named_struct(
               'general_issue_code', CASE WHEN x.p % 6 = 0 THEN NULL ELSE 'C' || CAST(x.p % 6 AS STRING) END,
               'description', CASE WHEN x.r = 'N' THEN ' ' ELSE x.r END,
               'lobbyists', array(named_struct('lobbyist', named_struct('id', CAST(x.s % 5 AS STRING), 'first_name', 'A', 'last_name', 'B'),
                                               'covered_position', CASE WHEN x.r = 'A' THEN ' Clerk ' END)))) AS lobbying_activities,
           transform(lines, x -> named_struct('name', CAST(x.s AS STRING), 'country', x.f, 'ppb_country', ' ')) AS foreign_entities
    FROM {{orders}} LEFT JOIN ({LINES}) l ON l_orderkey = o_orderkey""",
    )


def _us_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        lobbying.us_registrations(_filings(spark, sf_dir)).select(
            "registration_id", "period_start", "period_end", "client_id", "client_country", "spend_low", "issue_area",
            "client_ppb_country",
        )
    )


def _us_lobbyists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lobbying.us_lobbyists(_filings(spark, sf_dir)).select(
        "registration_id", "lobbyist_id", "name", "former_public_office"
    )


def _us_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lobbying.us_activities(_filings(spark, sf_dir))


def _us_foreign_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lobbying.us_foreign_entities(_filings(spark, sf_dir))


def _us_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _sql(
        spark, sf_dir,
        f"""
    SELECT CAST(l_orderkey AS STRING) AS filing_uuid,
           transform(lines, x -> named_struct('payee_name', ' P' || CAST(x.s AS STRING) || ' ', 'honoree_name', CASE WHEN x.r = 'N' THEN '' ELSE x.r END,
                                              'amount', CASE WHEN x.f = 'F' THEN 'unknown' ELSE CAST(x.v AS STRING) END,
                                              'contributor_name', CAST(x.p AS STRING))) AS contribution_items
    FROM ({LINES})""",
    )
    return rounded(lobbying.us_contributions(reports))


def _ca_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _sql(
        spark, sf_dir,
        """
    SELECT CAST(o_orderkey AS STRING) AS COMLOG_ID,
           CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_orderkey - 1 AS STRING) ELSE ' ' END AS PREV_COMLOG_ID_PRECEDNT,
           CAST(o_orderdate AS STRING) AS COMM_DATE, CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '3' END AS REG_TYPE_ENR,
           CAST(o_custkey AS STRING) AS REGISTRANT_NUM_DECLARANT, CAST(o_custkey % 7 AS STRING) AS CLIENT_ORG_CORP_NUM,
           '' AS EN_CLIENT_ORG_CORP_NM_AN, ' Bureau' AS FR_CLIENT_ORG_CORP_NM, 'Ann' AS RGSTRNT_1ST_NM_PRENOM_DCLRNT,
           CAST(o_custkey AS STRING) AS RGSTRNT_LAST_NM_DCLRNT
    FROM {orders}""",
    )
    officials = _sql(
        spark, sf_dir,
        """
    SELECT CAST(l_orderkey AS STRING) AS COMLOG_ID, 'X' AS DPOH_FIRST_NM_PRENOM_TCPD, CAST(l_suppkey AS STRING) AS DPOH_LAST_NM_TCPD,
           'T' AS DPOH_TITLE_TITRE_TCPD, CASE l_returnflag WHEN 'A' THEN 'Other' WHEN 'N' THEN '' ELSE 'Senate' END AS INSTITUTION,
           CASE WHEN l_linestatus = 'F' THEN 'Port' ELSE '' END AS OTHER_INSTITUTION_AUTRE
    FROM {lineitem}""",
    )
    about = _sql(
        spark, sf_dir,
        """
    SELECT CAST(l_orderkey AS STRING) AS COMLOG_ID, 'SMT-' || CAST(l_partkey % 6 AS STRING) AS SUBJECT_CODE_OBJET FROM {lineitem}""",
    )
    codes = _sql(
        spark, sf_dir, "SELECT 'SMT-' || CAST(r_regionkey AS STRING) AS SUBJECT_CODE_OBJET, r_name AS SMT_EN_DESC FROM {region}"
    )
    return lobbying.ca_contacts(reports, officials, about, codes).drop("official_title")


def _ca_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = _sql(
        spark, sf_dir,
        """
    SELECT CAST(o_orderkey AS STRING) AS REG_ID_ENR, CAST(o_orderkey % 3 + 1 AS STRING) AS REG_TYPE_ENR,
           CAST(o_orderdate AS STRING) AS EFFECTIVE_DATE_VIGUEUR, CASE WHEN o_orderstatus = 'F' THEN '2002-02-02' ELSE 'open' END AS END_DATE_FIN,
           CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'Client' END AS EN_CLIENT_NM_AN, 'Bureau' AS FR_CLIENT_NM,
           CAST(o_custkey % 7 AS STRING) AS CLIENT_NUM, CAST(o_custkey AS STRING) AS RGSTRNT_NUM_DECLARANT,
           'Ann' AS RGSTRNT_1ST_NM_PRENOM_DCLRNT, CAST(o_custkey AS STRING) AS RGSTRNT_LAST_NM_DCLRNT, 'p' AS CLIENT_PROFILE_ID_PROFIL_CLIENT
    FROM {orders}""",
    )
    about = _sql(
        spark, sf_dir,
        """
    SELECT CAST(l_orderkey AS STRING) AS REG_ID_ENR, 'SMT-' || CAST(l_partkey % 6 AS STRING) AS SUBJECT_CODE_OBJET,
           'SMT-2,SMT-' || CAST(l_suppkey % 4 AS STRING) AS ASSOC_SUBJECT_CODES_OBJET FROM {lineitem}""",
    )
    codes = _sql(
        spark, sf_dir, "SELECT 'SMT-' || CAST(r_regionkey AS STRING) AS SUBJECT_CODE_OBJET, r_name AS SMT_EN_DESC FROM {region}"
    )
    return lobbying.ca_registrations(filed, [about], codes).select(
        "registration_id", "period_start", "period_end", "registrant_id", "registrant_name", "client_id", "client_name",
        "issue_area", "filing_type",
    )


def _eu_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    meetings = _sql(
        spark, sf_dir,
        f"""
    SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS date, CASE WHEN o_custkey % 2 = 0 THEN 'Trade' END AS dgname, 'TR' AS dgacronym,
           'Cabinet' AS cabinet, o_orderpriority AS location, o_orderstatus AS subject,
           named_struct('entity', transform(lines, x -> named_struct('id', CAST(x.s AS STRING), 'name', ' E' || CAST(x.s AS STRING)))) AS entities,
           named_struct('representative', transform(lines, x -> named_struct('name', x.r, 'title', 'Head'))) AS representatives
    FROM {{orders}} JOIN ({LINES}) l ON l_orderkey = o_orderkey""",
    )
    return lobbying.eu_contacts(meetings, "dg").select(
        "contact_id", "registrant_id", "registrant_name", "contact_date", "official_name", "institution", "subject"
    )


def _eu_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _sql(
        spark, sf_dir,
        f"""
    SELECT CAST(o_orderkey AS STRING) AS identificationCode, CAST(o_orderdate AS STRING) AS registrationDate, ' cat ' AS registrationCategory,
           named_struct('originalName', 'Org') AS name, named_struct('country', 'BE') AS headOffice,
           named_struct('interest', transform(lines, x -> named_struct('name', x.r))) AS interests,
           named_struct('closedYear', named_struct('startDate', CASE WHEN o_orderstatus = 'F' THEN '2023-01-01' END, 'endDate', '2023-12-31',
               'costs', named_struct('absoluteCost', CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS STRING) END,
                                     'range', named_struct('min', CASE WHEN o_orderstatus = 'F' THEN '5000' END, 'max', '9999')),
               'clients', named_struct('client', transform(filter(lines, x -> x.n > 5), x -> named_struct('name', CAST(x.s AS STRING),
                   'revenue', named_struct('absoluteCost', CAST(x.v AS STRING), 'range', named_struct('min', CAST(NULL AS STRING), 'max', CAST(NULL AS STRING)))))))) AS financialData
    FROM {{orders}} JOIN ({LINES}) l ON l_orderkey = o_orderkey""",
    )
    return rounded(
        lobbying.eu_registrations(table).select(
            "registration_id", "period_start", "client_name", "client_country", "spend_low", "spend_high", "issue_area"
        )
    )


def _foreign_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two rows each, or with a single row as an object."""
    one = F.struct(F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("Name"))
    two = F.array(F.struct(F.col("c_name").alias("Name")), F.struct(F.col("c_mktsegment").alias("Name")))

    def document(rows):
        return F.to_json(F.struct(F.struct(rows.alias("ROW")).alias("REGISTRANTS_ACTIVE")))

    documents = read(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, document(one)).otherwise(document(two)).alias("value")
    )
    return lobbying.us_foreign_agents(documents)


# ---------------------------------------------------------------- politics


def _legislators(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _sql(
        spark, sf_dir,
        """
    SELECT named_struct('bioguide', CAST(c_custkey AS STRING)) AS id,
           named_struct('official_full', CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'first', 'Jo', 'last', c_mktsegment) AS name,
           array(named_struct('type', 'rep', 'party', 'old', 'state', 'NY'),
                 named_struct('type', 'sen', 'party', c_mktsegment, 'state', CAST(c_nationkey AS STRING))) AS terms
    FROM {customer}""",
    )
    return politics.legislators(people)


def _committee_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    committees = _sql(
        spark, sf_dir,
        """
    SELECT CASE WHEN r_name = 'ASIA' THEN 'X' ELSE 'K' END || CAST(r_regionkey AS STRING) AS thomas_id, r_name AS name,
           array(named_struct('thomas_id', '01', 'name', 'Sub')) AS subcommittees
    FROM {region}""",
    )
    memberships = _sql(
        spark, sf_dir,
        """
    SELECT to_json(map('K' || CAST(c_nationkey % 5 AS STRING), array(named_struct('bioguide', CAST(c_custkey AS STRING), 'title', 'Chair')),
                       'K' || CAST(c_nationkey % 5 AS STRING) || '01', array(named_struct('bioguide', CAST(c_custkey AS STRING), 'title', '')))) AS value
    FROM {customer}""",
    )
    return politics.committee_assignments(memberships, committees)


def _press_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    releases = _sql(
        spark, sf_dir,
        """
    SELECT named_struct('bioguide_id', CAST(doc_id % 25 AS STRING), 'name', source) AS member, '2024-01-02' AS date, text,
           lang AS title, 'u' AS url FROM {documents}""",
    )
    return politics.press_releases(releases)


def _us_donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = _sql(
        spark, sf_dir,
        """
    SELECT CAST(o_orderkey AS STRING) AS sub_id, CAST(o_custkey AS STRING) AS committee_id,
           CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'Own name' END AS committee_name, 'T' AS recipient_committee_type,
           named_struct('name', 'Nested name', 'committee_type_full', CAST(NULL AS STRING)) AS committee, c_name AS contributor_name,
           'IND' AS entity_type, '' AS entity_type_desc, c_mktsegment AS contributor_employer, CAST(c_nationkey AS STRING) AS contributor_zip,
           o_totalprice AS contribution_receipt_amount, date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss") AS contribution_receipt_date
    FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    )
    return rounded(
        politics.us_donations(receipts).select(
            "donation_id", "recipient_id", "recipient_name", "recipient_type", "donor_name", "donor_type", "amount",
            "donation_date",
        )
    )


def _uk_donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _sql(
        spark, sf_dir,
        """
    SELECT CAST(o_orderkey AS STRING) AS ECRef, CAST(o_custkey AS STRING) AS RegulatedEntityId, ' Party ' AS RegulatedEntityName,
           'PP' AS RegulatedEntityType, 'Don' AS DonorName, '' AS DonorStatus, ' ' AS CompanyRegistrationNumber, 'AB1' AS Postcode,
           '£' || format_number(o_totalprice, 2) AS Value,
           CASE WHEN o_orderstatus = 'F' THEN '' ELSE date_format(o_orderdate, 'dd/MM/yyyy') END AS ReceivedDate,
           '03/02/2001' AS AcceptedDate
    FROM {orders}""",
    )
    return rounded(
        politics.uk_donations(table).select(
            "donation_id", "recipient_id", "recipient_name", "donor_type", "amount", "donation_date"
        )
    )


# ---------------------------------------------------------------- procurement


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = "named_struct('amount', {amount}, 'amountGross', {gross}, 'currency', {currency})"
    award_value = value.format(
        amount="CASE WHEN x.r = 'A' THEN x.v END", gross="CASE WHEN x.r = 'R' THEN x.v END", currency="'EUR'"
    )
    contract_value = value.format(amount="x.v * 2.0", gross="CAST(NULL AS DOUBLE)", currency="'GBP'")
    lot_value = value.format(amount="x.v", gross="CAST(NULL AS DOUBLE)", currency="'USD'")
    item = (
        "named_struct('classification', named_struct('scheme', CASE WHEN x.n = 2 THEN 'CPV' ELSE 'X' END, 'id', CAST(x.p AS STRING)), "
        "'additionalClassifications', CAST(NULL AS ARRAY<STRUCT<scheme:STRING,id:STRING>>))"
    )
    return _sql(
        spark, sf_dir,
        f"""
    SELECT 'r' AS id, CAST(o_orderkey AS STRING) AS ocid, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date,
           CASE WHEN o_orderstatus = 'F' THEN array('tender', 'contractAmendment') ELSE array('planning') END AS tag,
           named_struct('id', CAST(o_custkey AS STRING), 'name', 'B') AS buyer,
           named_struct('procurementMethod', CASE WHEN o_orderpriority <> '5-LOW' THEN 'open' END,
                        'classification', named_struct('scheme', 'CPV', 'id', CASE WHEN o_orderstatus = 'P' THEN 'main' END),
                        'items', transform(lines, x -> {item}),
                        'value', CAST(NULL AS STRUCT<amount:DOUBLE,amountGross:DOUBLE,currency:STRING>),
                        'lots', transform(filter(lines, x -> x.r = 'N'), x -> named_struct('id', CAST(x.p AS STRING), 'value', {lot_value})),
                        'tenderPeriod', CAST(NULL AS STRUCT<startDate:STRING,endDate:STRING>), 'numberOfTenderers', o_custkey % 9) AS tender,
           transform(lines, x -> named_struct('id', concat_ws('-', x.n, x.p, x.s), 'date', CAST(NULL AS STRING), 'value', {award_value},
               'relatedLots', array(CAST(x.p AS STRING)), 'suppliers', array(named_struct('id', CAST(x.s AS STRING), 'name', 'S')),
               'items', CAST(NULL AS ARRAY<STRUCT<classification:STRUCT<scheme:STRING,id:STRING>,additionalClassifications:ARRAY<STRUCT<scheme:STRING,id:STRING>>>>))) AS awards,
           transform(filter(lines, x -> x.r = 'N'), x -> named_struct('awardID', concat_ws('-', x.n, x.p, x.s), 'value', {contract_value},
               'dateSigned', '2002-02-02')) AS contracts,
           named_struct('statistics', transform(filter(lines, x -> x.f = 'F'), x -> named_struct('measure', 'bids', 'value', CAST(x.n AS BIGINT),
               'relatedLot', CAST(x.p AS STRING)))) AS bids
    FROM {{orders}} JOIN ({LINES}) l ON l_orderkey = o_orderkey""",
    )


def _ocds_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        procurement.ocds_processes(_releases(spark, sf_dir)).select(
            "process_id", "buyer_id", "category_code", "procurement_method", "tender_value", "currency",
            "tender_published_date", "number_of_tenderers",
        )
    )


def _ocds_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(procurement.ocds_awards(_releases(spark, sf_dir)).drop("supplier_name"))


def _us_awards(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    found = _sql(
        spark, sf_dir,
        """
    SELECT CAST(o_orderkey AS STRING) AS generated_internal_id, 'Listed agency' AS `Awarding Sub Agency`, 'LUEI' AS `Recipient UEI`,
           'Listed name' AS `Recipient Name`, '2001-01-01' AS `Base Obligation Date` FROM {orders}""",
    )
    details = _sql(
        spark, sf_dir,
        """
    SELECT CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE '' END || CAST(o_orderkey AS STRING) AS generated_internal_id,
           o_totalprice AS total_obligation,
           CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_signed,
           named_struct('subtier_agency', named_struct('code', CAST(o_custkey AS STRING), 'name', '')) AS awarding_agency,
           named_struct('recipient_uei', 'U', 'recipient_name', CASE WHEN o_custkey % 2 = 0 THEN 'N' END) AS recipient,
           named_struct('extent_competed', CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'CDO' WHEN '3-MEDIUM' THEN 'F'
                                                WHEN '4-NOT SPECIFIED' THEN 'NDO' ELSE 'Q' END,
                        'naics', '54', 'number_of_offers_received', CASE WHEN o_custkey % 3 = 0 THEN 'n/a' ELSE '4' END) AS latest_transaction_contract_data
    FROM {orders}""",
    )
    return [found, details]


def _us_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procurement.us_processes(*_us_awards(spark, sf_dir)).select(
        "process_id", "buyer_id", "buyer_name", "procurement_method", "number_of_tenderers"
    )


def _us_award_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        procurement.us_awards(*_us_awards(spark, sf_dir)).select(
            "award_id", "supplier_id", "supplier_name", "award_value", "award_date"
        )
    )


# ---------------------------------------------------------------- companies


def _uk_controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _sql(
        spark, sf_dir,
        """
    SELECT CAST(c_custkey AS STRING) AS company_number,
           CASE c_mktsegment WHEN 'BUILDING' THEN 'super-secure-person' WHEN 'MACHINERY' THEN 'individual-person' ELSE 'corporate-entity' END AS kind,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS name, 'protected' AS description, 'France' AS country_of_residence,
           array('a', 'b') AS natures_of_control, '2020-01-01' AS notified_on, CAST(NULL AS STRING) AS ceased_on,
           named_struct('year', 1970, 'month', CAST(c_custkey % 12 AS INT)) AS date_of_birth,
           named_struct('country_registered', CASE WHEN c_nationkey % 2 = 0 THEN 'Wales' ELSE 'Peru' END, 'place_registered', CAST(NULL AS STRING),
                        'registration_number', ' ' || CAST(c_custkey AS STRING)) AS identification
    FROM {customer}""",
    )
    return companies.uk_controllers(table).drop("ceased_on", "notified_on")


def _lei_controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = (
        "named_struct('jurisdiction', CASE WHEN c_custkey % 2 = 0 THEN 'us-DE' END, 'status', 'ACTIVE', 'creationDate', '', "
        "'legalName', named_struct('name', c_name), 'expiration', named_struct('reason', '', 'date', ''), "
        "'legalAddress', named_struct('addressLines', array(''), 'postalCode', '', 'city', '', 'country', 'fr'))"
    )
    parent = "named_struct('attributes', named_struct('lei', {lei}, 'entity', " + entity + "))"
    parents = _sql(
        spark, sf_dir,
        "SELECT CAST(c_custkey AS STRING) AS lei, 'ultimate-parent' AS level, "
        + parent.format(lei="CAST(c_custkey % 50 AS STRING)")
        + " AS data FROM {customer} UNION ALL SELECT CAST(c_custkey AS STRING), 'direct-parent', "
        + parent.format(lei="CAST(c_custkey % 100 AS STRING)")
        + " FROM {customer}",
    )
    return companies.lei_controllers(parents).drop("notified_on", "ceased_on")


def _no_officers(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = _sql(
        spark, sf_dir,
        f"""
    SELECT CAST(l_orderkey AS STRING) AS organisasjonsnummer, array(named_struct('roller', transform(lines, x -> named_struct(
               'avregistrert', x.f = 'F', 'type', named_struct('kode', x.r),
               'person', named_struct('fodselsdato', CASE WHEN x.n > 2 THEN '1980-01-01' END,
                                      'navn', named_struct('fornavn', 'Kari', 'mellomnavn', '', 'etternavn', CAST(x.p AS STRING))),
               'enhet', named_struct('organisasjonsnummer', CASE WHEN x.r = 'A' THEN CAST(x.s AS STRING) END, 'navn', array('Rev', 'AS')))))) AS rollegrupper
    FROM ({LINES})""",
    )
    return companies.no_officers(roles).select("company_id", "officer_id", "name", "role")


# ---------------------------------------------------------------- court


def _case_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    parties = _sql(
        spark, sf_dir,
        f"""
    SELECT l_orderkey AS docket_id, ' Party ' AS name,
           transform(lines, x -> named_struct('name', CASE WHEN x.r = 'N' THEN ' ' ELSE x.r END,
                                              'docket_id', CASE WHEN x.f = 'F' THEN l_orderkey WHEN x.n > 3 THEN l_orderkey + 1 END)) AS party_types
    FROM ({LINES})""",
    )
    return court.case_parties(parties)


def _judge_interests(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = _sql(
        spark, sf_dir,
        """
    SELECT 'https://x.example/people/' || CAST(p_partkey AS STRING) || '/' AS person, 2000 + p_partkey % 20 AS year, p_type AS filepath,
           array(named_struct('description', p_brand, 'gross_value_code', CASE p_size % 4 WHEN 0 THEN 'J' WHEN 1 THEN 'P4' WHEN 2 THEN 'N' END)) AS investments,
           array(named_struct('source', CASE WHEN p_size % 2 = 0 THEN p_name ELSE ' ' END, 'description', ' pen', 'value', '$' || format_number(p_retailprice, 2))) AS gifts,
           array(named_struct('source', p_brand, 'date_raw', 'May', 'location', '', 'purpose', p_type, 'items_paid_or_provided', CAST(NULL AS STRING))) AS reimbursements,
           CAST(NULL AS ARRAY<STRUCT<organization_name:STRING,position:STRING>>) AS positions,
           CAST(NULL AS ARRAY<STRUCT<parties_and_terms:STRING,date_raw:STRING>>) AS agreements,
           array(named_struct('source_type', p_name, 'date_raw', '', 'income_amount', 'unknown')) AS non_investment_incomes,
           CAST(NULL AS ARRAY<STRUCT<source_type:STRING,date_raw:STRING>>) AS spouse_incomes,
           array(named_struct('creditor_name', p_type, 'description', 'loan', 'value_code', 'K')) AS debts
    FROM {part}""",
    )
    return rounded(
        court.judge_interests(reports.withColumn("year", F.col("year").cast("long"))).drop("judge_name", "url")
    )


# ---------------------------------------------------------------- parliaments and statistics


def _ep_member_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are members; every seventh has a mandate that ends, and groups change in 1998."""
    member = "named_struct('organization', {org}, 'membershipClassification', {kind}, 'role', {role}, 'memberDuring', named_struct('startDate', {start}, 'endDate', {end}), 'represents', array('x/FRA'))"
    group = "'def/ep-entities/EU_POLITICAL_GROUP'"
    people = _sql(
        spark, sf_dir,
        "SELECT CAST(s_suppkey AS STRING) AS identifier, s_name AS label, array("
        + member.format(org="'org/ep-9'", kind="CAST(NULL AS STRING)", role=f"'{parliament.EP_MANDATE}'", start="'1995-01-01'",
                        end="CASE WHEN s_suppkey % 7 = 0 THEN '1999-05-05' END")
        + ", " + member.format(org="'org/' || CAST(s_suppkey % 3 AS STRING)", kind=group, role="CAST(NULL AS STRING)", start="'1995-01-01'", end="'1998-03-03'")
        + ", " + member.format(org="'org/' || CAST(s_suppkey % 2 AS STRING)", kind=group, role="CAST(NULL AS STRING)", start="'1998-03-04'", end="CAST(NULL AS STRING)")
        + ") AS hasMembership FROM {supplier}",
    )
    decisions = _sql(
        spark, sf_dir,
        f"""
    SELECT 'eli/x' AS id, '' AS identifier, CAST(l_shipdate AS STRING) AS notation_votingId, CAST(CAST(l_shipdate AS DATE) AS STRING) AS activity_date,
           '{parliament.EP_ROLL_CALL}' AS decision_method, CAST(NULL AS MAP<STRING,STRING>) AS activity_label,
           CAST(NULL AS ARRAY<STRING>) AS decided_on_a_realization_of,
           collect_set(CASE WHEN l_returnflag = 'A' THEN 'person/' || CAST(l_suppkey AS STRING) END) AS had_voter_favor,
           collect_set(CASE WHEN l_returnflag = 'N' THEN 'person/' || CAST(l_suppkey AS STRING) END) AS had_voter_against,
           collect_set(CASE WHEN l_returnflag = 'R' THEN 'person/' || CAST(l_suppkey AS STRING) END) AS had_voter_abstention
    FROM {{lineitem}} GROUP BY l_shipdate""",
    )
    bodies = _sql(
        spark, sf_dir, "SELECT CAST(r_regionkey AS STRING) AS identifier, r_name AS label FROM {region}"
    )
    votes = parliament.ep_member_votes(decisions, people, bodies, 9)
    return votes.groupBy("member_id", "position", "group_at_vote").agg(F.count(F.lit(1)).alias("votes"))


def _ch_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes, votings = bind(spark, sf_dir, "parl_member_votes", "parl_votings")
    votes = votes.withColumn(
        "group_at_vote",
        F.concat("group_at_vote", F.lit("/"), F.substring("voting_id", 1, 4)),
    )
    return parliament.ch_affiliations(votes, votings).select("member_id", "parliament", "org_name", "start_date", "end_date")


def _cube_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cube per nation: status, priority and year, order counts as values, large totals flagged."""
    cubes = _sql(
        spark, sf_dir,
        """
    SELECT CAST(c_nationkey AS STRING) AS dataset_code, 'dataset' AS class, 'Orders' AS label, 'now' AS updated,
           array('status', 'unit', 'time') AS id, array(CAST(3 AS BIGINT), CAST(5 AS BIGINT), CAST(7 AS BIGINT)) AS size,
           to_json(map_from_entries(collect_list(struct(CAST(cell AS STRING) AS k, n AS v)))) AS value,
           to_json(map_from_entries(collect_list(struct(CAST(cell AS STRING) AS k, flag AS v)))) AS status,
           map('status', named_struct('category', named_struct('index', '{{"F":0,"O":1,"P":2}}', 'label', map('F', 'final'))),
               'unit', named_struct('category', named_struct('index', '["1","2","3","4","5"]', 'label', map('1', 'urgent'))),
               'time', named_struct('category', named_struct('index', '{{"1995":0,"1996":1,"1997":2,"1998":3,"1999":4,"2000":5,"2001":6}}', 'label', map('x', 'y')))) AS dimension,
           named_struct('status', named_struct('label', map('e', 'estimated'))) AS extension
    FROM (SELECT c_nationkey, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END * 5
                               + CAST(substr(o_orderpriority, 1, 1) AS INT) - 1) * 7 + year(o_orderdate) - 1995 AS cell,
                 CAST(count(*) AS DOUBLE) AS n, CASE WHEN count(*) > 5 THEN 'e' END AS flag
          FROM {orders} JOIN {customer} ON c_custkey = o_custkey GROUP BY 1, 2)
    GROUP BY c_nationkey""",
    )
    found = statistics.cube_observations(cubes)
    return found.select(
        "dataset_code", "time_period", "unit", "value", "status", "status_label",
        F.col("dimensions")["status"].alias("status_code"), F.col("dimension_labels")["status"].alias("status_name"),
    )


LANDED_QUERIES: dict[str, Query] = {
    "landed.us_lobbying_registrations": _us_registrations,
    "landed.us_lobbying_lobbyists": _us_lobbyists,
    "landed.us_lobbying_activities": _us_activities,
    "landed.us_lobbying_foreign_entities": _us_foreign_entities,
    "landed.us_lobbying_contributions": _us_contributions,
    "landed.ca_lobbying_contacts": _ca_contacts,
    "landed.ca_lobbying_registrations": _ca_registrations,
    "landed.eu_lobbying_contacts": _eu_contacts,
    "landed.eu_lobbying_registrations": _eu_registrations,
    "landed.us_foreign_agents": _foreign_agents,
    "landed.us_legislators": _legislators,
    "landed.us_committee_assignments": _committee_assignments,
    "landed.us_press_releases": _press_releases,
    "landed.us_donations": _us_donations,
    "landed.uk_donations": _uk_donations,
    "landed.ocds_processes": _ocds_processes,
    "landed.ocds_awards": _ocds_awards,
    "landed.us_award_processes": _us_processes,
    "landed.us_awards": _us_award_rows,
    "landed.uk_controllers": _uk_controllers,
    "landed.lei_controllers": _lei_controllers,
    "landed.no_officers": _no_officers,
    "landed.court_case_parties": _case_parties,
    "landed.judge_interests": _judge_interests,
    "landed.ep_member_votes": _ep_member_votes,
    "landed.ch_affiliations": _ch_affiliations,
    "landed.cube_observations": _cube_observations,
}

_NUMBERED = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag,
                                          l_extendedprice, l_linestatus) AS nth FROM lineitem)"""
_TEXT = "CAST({} AS VARCHAR)"
_SUBJECTS = """
subjects AS (SELECT rec, string_agg(label, '|' ORDER BY label) AS s
             FROM (SELECT DISTINCT m.l_orderkey AS rec, coalesce(r.r_name, 'SMT-' || CAST(m.k AS VARCHAR)) AS label
                   FROM ({mentions}) AS m LEFT JOIN region r ON r.r_regionkey = m.k) AS d GROUP BY rec)"""

LANDED_ORACLES: dict[str, str] = {
    "landed.us_lobbying_registrations": f"""
WITH {_NUMBERED},
issues AS (SELECT l_orderkey, string_agg(code, '|' ORDER BY first) AS issue_area FROM (
    SELECT l_orderkey, 'C' || CAST(l_partkey % 6 AS VARCHAR) AS code, min(nth) AS first FROM numbered WHERE l_partkey % 6 <> 0 GROUP BY 1, 2) AS c
    GROUP BY l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS registration_id,
       make_date(year(o_orderdate), CASE o_orderpriority WHEN '3-MEDIUM' THEN 10 ELSE 1 END, 1) AS period_start,
       make_date(year(o_orderdate), CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 6 ELSE 12 END,
                 CASE o_orderpriority WHEN '2-HIGH' THEN 30 ELSE 31 END) AS period_end,
       CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey % 9 AS VARCHAR) END AS client_id, 'FR' AS client_country,
       round(CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN CAST(77.5 AS DOUBLE) END + 0.0000003, 4) AS spend_low,
       i.issue_area, NULL AS client_ppb_country
FROM orders LEFT JOIN issues i ON i.l_orderkey = o_orderkey""",
    "landed.us_lobbying_lobbyists": """
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS registration_id, CAST(l_suppkey % 5 AS VARCHAR) AS lobbyist_id, 'A B' AS name,
       CASE WHEN l_returnflag = 'A' THEN 'Clerk' END AS former_public_office
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "landed.us_lobbying_activities": f"""
WITH {_NUMBERED}
SELECT CAST(l_orderkey AS VARCHAR) AS registration_id,
       CASE WHEN l_partkey % 6 <> 0 THEN 'C' || CAST(l_partkey % 6 AS VARCHAR) END AS general_issue_code,
       CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS description, nth - 1 AS activity_index
FROM numbered JOIN orders ON o_orderkey = l_orderkey""",
    "landed.us_lobbying_foreign_entities": """
SELECT CAST(l_orderkey AS VARCHAR) AS registration_id, CAST(l_suppkey AS VARCHAR) AS foreign_entity_name, l_linestatus AS country,
       NULL AS ppb_country
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "landed.us_lobbying_contributions": """
SELECT CAST(l_orderkey AS VARCHAR) AS registration_id, 'P' || CAST(l_suppkey AS VARCHAR) AS payee_name,
       CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS honoree_name,
       CASE WHEN l_linestatus <> 'F' THEN round(l_extendedprice + 0.0000003, 4) END AS amount,
       CAST(l_partkey AS VARCHAR) AS contributor_name
FROM lineitem""",
    "landed.ca_lobbying_contacts": "WITH "
    + _SUBJECTS.format(mentions="SELECT l_orderkey, l_partkey % 6 AS k FROM lineitem")
    + """
SELECT CAST(o.o_orderkey AS VARCHAR) AS contact_id,
       CASE WHEN o.o_orderstatus = 'F' THEN CAST(o.o_custkey AS VARCHAR) ELSE 'org-' || CAST(o.o_custkey % 7 AS VARCHAR) END AS registrant_id,
       CASE WHEN o.o_orderstatus = 'F' THEN 'Ann ' || CAST(o.o_custkey AS VARCHAR) ELSE 'Bureau' END AS registrant_name,
       CAST(o.o_orderdate AS DATE) AS contact_date, 'X ' || CAST(l.l_suppkey AS VARCHAR) AS official_name,
       CASE WHEN l.l_returnflag = 'R' THEN 'Senate' WHEN l.l_linestatus = 'F' THEN 'Port' WHEN l.l_returnflag = 'A' THEN 'Other' END AS institution,
       s.s AS subject
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN subjects s ON s.rec = o.o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_orderpriority = '1-URGENT' AND n.o_orderkey - 1 = o.o_orderkey)""",
    "landed.ca_lobbying_registrations": "WITH "
    + _SUBJECTS.format(
        mentions="SELECT l_orderkey, l_partkey % 6 AS k FROM lineitem UNION SELECT l_orderkey, 2 FROM lineitem "
        "UNION SELECT l_orderkey, l_suppkey % 4 FROM lineitem"
    )
    + """
SELECT CAST(o_orderkey AS VARCHAR) AS registration_id, CAST(o_orderdate AS DATE) AS period_start,
       CASE WHEN o_orderstatus = 'F' THEN DATE '2002-02-02' END AS period_end,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'org-' || CAST(o_custkey % 7 AS VARCHAR) END AS registrant_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Ann ' || CAST(o_custkey AS VARCHAR) WHEN o_orderpriority = '5-LOW' THEN 'Bureau' ELSE 'Client' END AS registrant_name,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 7 AS VARCHAR) END AS client_id,
       CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderpriority = '5-LOW' THEN 'Bureau' ELSE 'Client' END END AS client_name,
       s.s AS issue_area,
       CASE o_orderkey % 3 WHEN 0 THEN 'consultant' WHEN 1 THEN 'in-house corporation' ELSE 'in-house organization' END AS filing_type
FROM orders LEFT JOIN subjects s ON s.rec = o_orderkey""",
    "landed.eu_lobbying_contacts": """
WITH m AS (
    SELECT o.*, CASE WHEN o_custkey % 2 = 0 THEN 'Trade (TR)' ELSE 'Cabinet' END AS institution FROM orders o
),
h AS (SELECT *, substr(sha256('dg' || chr(31) || institution || chr(31) || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || chr(31)
                              || o_orderpriority || chr(31) || o_orderstatus), 1, 16) AS contact_id FROM m)
SELECT DISTINCT h.contact_id, CAST(e.l_suppkey AS VARCHAR) AS registrant_id, 'E' || CAST(e.l_suppkey AS VARCHAR) AS registrant_name,
       CAST(h.o_orderdate AS DATE) AS contact_date, p.l_returnflag AS official_name, h.institution, h.o_orderstatus AS subject
FROM h JOIN lineitem e ON e.l_orderkey = h.o_orderkey JOIN lineitem p ON p.l_orderkey = h.o_orderkey""",
    "landed.eu_lobbying_registrations": f"""
WITH {_NUMBERED},
tags AS (SELECT l_orderkey, string_agg(l_returnflag, '|' ORDER BY nth) AS issue_area FROM numbered GROUP BY 1),
c AS (SELECT l_orderkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_linenumber > 5)
SELECT CAST(o_orderkey AS VARCHAR) AS registration_id,
       CASE WHEN o_orderstatus = 'F' THEN DATE '2023-01-01' ELSE CAST(o_orderdate AS DATE) END AS period_start,
       CAST(c.l_suppkey AS VARCHAR) AS client_name, CASE WHEN c.l_orderkey IS NULL THEN 'BE' END AS client_country,
       round(CASE WHEN c.l_orderkey IS NOT NULL THEN c.l_extendedprice WHEN o_orderstatus = 'O' THEN o_totalprice
                  WHEN o_orderstatus = 'F' THEN CAST(5000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + 0.0000003, 4) AS spend_low,
       round(CASE WHEN c.l_orderkey IS NOT NULL THEN c.l_extendedprice WHEN o_orderstatus = 'O' THEN o_totalprice
                  ELSE CAST(9999 AS DOUBLE) END + 0.0000003, 4) AS spend_high, t.issue_area
FROM orders JOIN tags t ON t.l_orderkey = o_orderkey LEFT JOIN c ON c.l_orderkey = o_orderkey""",
    "landed.us_foreign_agents": """
SELECT c_name AS registrant_name FROM customer UNION ALL SELECT c_mktsegment FROM customer WHERE c_custkey % 2 = 1""",
    "landed.us_legislators": """
SELECT CAST(c_custkey AS VARCHAR) AS bioguide_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Jo ' || c_mktsegment END AS name,
       c_mktsegment AS party, CAST(c_nationkey AS VARCHAR) AS state
FROM customer""",
    "landed.us_committee_assignments": """
SELECT CAST(c_custkey AS VARCHAR) AS bioguide_id, coalesce(r_name, 'K' || CAST(c_nationkey % 5 AS VARCHAR)) AS committee_name, 'Chair' AS role
FROM customer LEFT JOIN region ON r_regionkey = c_nationkey % 5 AND r_name <> 'ASIA'
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), coalesce(r_name || ': Sub', 'K' || CAST(c_nationkey % 5 AS VARCHAR) || '01'), 'Member'
FROM customer LEFT JOIN region ON r_regionkey = c_nationkey % 5 AND r_name <> 'ASIA'""",
    "landed.us_press_releases": """
SELECT CAST(doc_id % 25 AS VARCHAR) AS bioguide_id, DATE '2024-01-02' AS date, source AS member_name, text, lang AS title, 'u' AS url
FROM documents""",
    "landed.us_donations": """
SELECT CAST(o_orderkey AS VARCHAR) AS donation_id, CAST(o_custkey AS VARCHAR) AS recipient_id,
       CASE WHEN o_orderstatus = 'F' THEN 'Nested name' ELSE 'Own name' END AS recipient_name, 'T' AS recipient_type, c_name AS donor_name,
       'IND' AS donor_type, round(o_totalprice + 0.0000003, 4) AS amount, CAST(o_orderdate AS DATE) AS donation_date
FROM orders JOIN customer ON c_custkey = o_custkey""",
    "landed.uk_donations": """
SELECT CAST(o_orderkey AS VARCHAR) AS donation_id, CAST(o_custkey AS VARCHAR) AS recipient_id, 'Party' AS recipient_name,
       NULL AS donor_type, round(o_totalprice + 0.0000003, 4) AS amount,
       CASE WHEN o_orderstatus = 'F' THEN DATE '2001-02-03' ELSE CAST(o_orderdate AS DATE) END AS donation_date
FROM orders""",
    "landed.ocds_processes": f"""
WITH {_NUMBERED},
cpv AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS code FROM numbered n
        WHERE l_linenumber = 2 AND nth = (SELECT min(m.nth) FROM numbered m WHERE m.l_orderkey = n.l_orderkey AND m.l_linenumber = 2)),
lots AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS lot, l_extendedprice AS v FROM lineitem WHERE l_returnflag = 'N'),
listed AS (SELECT DISTINCT l_orderkey FROM lineitem),
bids AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS lot, min(nth) AS first FROM numbered WHERE l_linestatus = 'F' GROUP BY 1, 2),
bid AS (SELECT b.l_orderkey, b.lot, n.l_linenumber AS value FROM bids b JOIN numbered n ON n.l_orderkey = b.l_orderkey AND n.nth = b.first)
SELECT CASE WHEN t.lot IS NULL THEN CAST(o_orderkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) || '/' || t.lot END AS process_id,
       CAST(o_custkey AS VARCHAR) AS buyer_id, CASE WHEN o_orderstatus = 'P' THEN 'main' ELSE c.code END AS category_code,
       CASE WHEN o_orderpriority <> '5-LOW' THEN 'open' END AS procurement_method, round(t.v + 0.0000003, 4) AS tender_value,
       CASE WHEN t.lot IS NOT NULL THEN 'USD' END AS currency,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS tender_published_date,
       coalesce(CAST(b.value AS BIGINT), o_custkey % 9) AS number_of_tenderers
FROM orders JOIN listed x ON x.l_orderkey = o_orderkey LEFT JOIN lots t ON t.l_orderkey = o_orderkey
LEFT JOIN cpv c ON c.l_orderkey = o_orderkey LEFT JOIN bid b ON b.l_orderkey = o_orderkey AND b.lot = t.lot
WHERE o_orderpriority <> '5-LOW' OR t.lot IS NOT NULL""",
    "landed.ocds_awards": """
WITH l AS (SELECT *, CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS award FROM lineitem),
signed AS (SELECT l_orderkey, award, sum(l_extendedprice * 2.0) AS v FROM l WHERE l_returnflag = 'N' GROUP BY 1, 2),
lots AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'N')
SELECT CAST(o_orderkey AS VARCHAR) || '/' || l.award AS award_id,
       CASE WHEN t.l_partkey IS NOT NULL THEN CAST(o_orderkey AS VARCHAR) || '/' || CAST(l.l_partkey AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS process_id,
       CAST(l.l_suppkey AS VARCHAR) AS supplier_id,
       round(CASE WHEN l.l_returnflag = 'N' THEN s.v ELSE l.l_extendedprice END + 0.0000003, 4) AS award_value,
       CASE WHEN l.l_returnflag = 'N' THEN 'GBP' ELSE 'EUR' END AS currency,
       CASE WHEN s.award IS NOT NULL THEN DATE '2002-02-02' ELSE CAST(o_orderdate AS DATE) END AS award_date,
       CAST(NULL AS DOUBLE) AS final_value
FROM orders JOIN l ON l.l_orderkey = o_orderkey LEFT JOIN signed s ON s.l_orderkey = o_orderkey AND s.award = l.award
LEFT JOIN lots t ON t.l_orderkey = l.l_orderkey AND t.l_partkey = l.l_partkey
UNION ALL
SELECT CAST(o_orderkey AS VARCHAR) || '/' || l.award, NULL, NULL, NULL, 'GBP', NULL, round(l.l_extendedprice * 2.0 + 0.0000003, 4)
FROM orders JOIN l ON l.l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l.l_returnflag = 'N'""",
    "landed.us_award_processes": """
SELECT CAST(o_orderkey AS VARCHAR) AS process_id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS buyer_id,
       'Listed agency' AS buyer_name,
       CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'open' WHEN o_orderpriority = '2-HIGH' THEN 'selective'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'limited' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'direct' END AS procurement_method,
       CASE WHEN o_orderstatus <> 'P' AND o_custkey % 3 <> 0 THEN CAST(4 AS BIGINT) END AS number_of_tenderers
FROM orders""",
    "landed.us_awards": """
SELECT CAST(o_orderkey AS VARCHAR) AS award_id, CASE WHEN o_orderstatus = 'P' THEN 'LUEI' ELSE 'U' END AS supplier_id,
       CASE WHEN o_orderstatus <> 'P' AND o_custkey % 2 = 0 THEN 'N' ELSE 'Listed name' END AS supplier_name,
       CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice + 0.0000003, 4) END AS award_value,
       CASE WHEN o_orderstatus = 'P' THEN DATE '2001-01-01' ELSE CAST(o_orderdate AS DATE) END AS award_date
FROM orders""",
    "landed.uk_controllers": """
SELECT 'gb:' || CAST(c_custkey AS VARCHAR) AS company_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'gb:statement:super-secure-person'
            WHEN 'MACHINERY' THEN 'gb:psc:' || upper(c_name) || CASE WHEN c_custkey % 12 > 0 THEN '|1970-' || lpad(CAST(c_custkey % 12 AS VARCHAR), 2, '0') ELSE '' END
            ELSE 'gb:psc:' || upper(c_name) END AS controller_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'protected' ELSE c_name END AS controller_name,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'statement' WHEN 'MACHINERY' THEN 'individual' ELSE 'legal_entity' END AS controller_kind,
       CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'France' WHEN c_nationkey % 2 = 0 THEN 'Wales' ELSE 'Peru' END AS controller_country,
       CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_nationkey % 2 = 0 THEN 'gb:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS controller_company_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'super-secure-person' ELSE 'a|b' END AS control_type
FROM customer""",
    "landed.lei_controllers": """
SELECT 'lei:' || CAST(c_custkey AS VARCHAR) AS company_id, 'lei:' || CAST(k AS VARCHAR) AS controller_id, c_name AS controller_name,
       'legal_entity' AS controller_kind, CASE WHEN c_custkey % 2 = 0 THEN 'US' ELSE 'FR' END AS controller_country,
       'lei:' || CAST(k AS VARCHAR) AS controller_company_id, min(level) AS control_type
FROM (SELECT *, c_custkey % 100 AS k, 'direct-parent' AS level FROM customer
      UNION ALL SELECT *, c_custkey % 50, 'ultimate-parent' FROM customer) AS parents
GROUP BY c_custkey, c_name, k""",
    "landed.no_officers": """
SELECT 'no:' || CAST(l_orderkey AS VARCHAR) AS company_id,
       CASE WHEN l_returnflag = 'A' THEN 'no:' || CAST(l_suppkey AS VARCHAR)
            ELSE 'no:person:KARI ' || CAST(l_partkey AS VARCHAR) || '|' || CASE WHEN l_linenumber > 2 THEN '1980-01-01' ELSE '' END END AS officer_id,
       CASE WHEN l_returnflag = 'A' THEN 'Rev AS' ELSE 'Kari ' || CAST(l_partkey AS VARCHAR) END AS name, l_returnflag AS role
FROM lineitem WHERE l_linestatus <> 'F'""",
    "landed.court_case_parties": """
WITH r AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem
           WHERE l_returnflag <> 'N' AND (l_linestatus = 'F' OR l_linenumber <= 3))
SELECT CAST(d.l_orderkey AS VARCHAR) AS case_id, 'Party' AS party_name, r.l_returnflag AS party_role
FROM (SELECT DISTINCT l_orderkey FROM lineitem) AS d LEFT JOIN r ON r.l_orderkey = d.l_orderkey""",
    "landed.judge_interests": """
WITH p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS judge_id, 2000 + p_partkey % 20 AS report_year, round(p_retailprice + 0.0000003, 4) AS price FROM part)
SELECT judge_id, report_year, 'investment' AS interest_type, p_brand AS counterparty, NULL AS description,
       CASE p_size % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 50000001.0::DOUBLE WHEN 2 THEN 250001.0::DOUBLE END AS value_low,
       CASE p_size % 4 WHEN 0 THEN 15000.0::DOUBLE WHEN 2 THEN 500000.0::DOUBLE END AS value_high FROM p
UNION ALL SELECT judge_id, report_year, 'gift', p_name, 'pen', price, price FROM p WHERE p_size % 2 = 0
UNION ALL SELECT judge_id, report_year, 'reimbursement', p_brand, 'May; ' || p_type, NULL, NULL FROM p
UNION ALL SELECT judge_id, report_year, 'income', p_name, NULL, NULL, NULL FROM p
UNION ALL SELECT judge_id, report_year, 'debt', p_type, 'loan', 15001.0::DOUBLE, 50000.0::DOUBLE FROM p""",
    "landed.ep_member_votes": """
WITH days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
voted AS (SELECT CAST(l_shipdate AS DATE) AS d, l_suppkey AS m, max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS w
          FROM lineitem GROUP BY 1, 2),
seated AS (SELECT d, s_suppkey AS m FROM days, supplier WHERE s_suppkey % 7 <> 0 OR d <= DATE '1999-05-05'),
roll AS (SELECT coalesce(v.d, s.d) AS d, coalesce(v.m, s.m) AS m, v.w FROM voted v FULL JOIN seated s ON s.d = v.d AND s.m = v.m)
SELECT CAST(m AS VARCHAR) AS member_id, CASE w WHEN 1 THEN 'for' WHEN 2 THEN 'against' WHEN 3 THEN 'abstain' ELSE 'absent' END AS position,
       r_name AS group_at_vote, count(*) AS votes
FROM roll LEFT JOIN supplier ON s_suppkey = m
LEFT JOIN region ON r_regionkey = CASE WHEN s_suppkey IS NOT NULL THEN CASE WHEN d <= DATE '1998-03-03' THEN m % 3 ELSE m % 2 END END
GROUP BY 1, 2, 3""",
    "landed.ch_affiliations": "WITH "
    + sql_views("parl_member_votes", "parl_votings")
    + """,
seen AS (
    SELECT DISTINCT v.parliament, v.member_id, t.vote_date, v.group_at_vote || '/' || substr(v.voting_id, 1, 4) AS g
    FROM parl_member_votes v JOIN parl_votings t ON t.parliament = v.parliament AND t.voting_id = v.voting_id
    WHERE v.group_at_vote IS NOT NULL
),
runs AS (
    SELECT *, row_number() OVER (PARTITION BY parliament, member_id ORDER BY vote_date, g)
              - row_number() OVER (PARTITION BY parliament, member_id, g ORDER BY vote_date) AS island FROM seen
),
spans AS (SELECT parliament, member_id, g, island, min(vote_date) AS a, max(vote_date) AS b FROM runs GROUP BY 1, 2, 3, 4)
SELECT member_id, parliament, g AS org_name, a AS start_date,
       CASE WHEN row_number() OVER (PARTITION BY parliament, member_id ORDER BY a DESC, g DESC) > 1 THEN b END AS end_date
FROM spans""",
    "landed.cube_observations": """
SELECT CAST(c_nationkey AS VARCHAR) AS dataset_code, CAST(year(o_orderdate) AS VARCHAR) AS time_period, substr(o_orderpriority, 1, 1) AS unit,
       CAST(count(*) AS DOUBLE) AS value, CASE WHEN count(*) > 5 THEN 'e' END AS status,
       CASE WHEN count(*) > 5 THEN 'estimated' END AS status_label, o_orderstatus AS status_code,
       CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE o_orderstatus END AS status_name
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey, year(o_orderdate), substr(o_orderpriority, 1, 1), o_orderstatus""",
}
