"""Registered queries of landed recipients and companies, whole rows, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadspark.sources.landed import companies, politics
from leadspark.testbed.landed_queries import _sql
from leadspark.testbed.queries import Query


def _us_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    committees = """
    SELECT CAST(c_custkey AS STRING) AS committee_id, c_name AS name,
           CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '2020-01-' || lpad(CAST(c_nationkey + 1 AS STRING), 2, '0') || 'T00:00:00' END AS first_f1_date,
           CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE '2019-05-04' END AS first_file_date
    FROM {customer}"""
    return politics.us_recipients(_sql(spark, sf_dir, committees))


def _uk_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = """
    SELECT CASE WHEN c_custkey % 4 = 0 THEN 'PP' ELSE ' TP' || CAST(c_custkey AS STRING) || ' ' END AS ECRef, ' ' || c_name AS RegulatedEntityName,
           CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lpad(CAST(c_nationkey + 1 AS STRING), 2, '0') || '/11/2011' END AS ApprovedDate
    FROM {customer} WHERE c_custkey % 5 <> 0 OR c_custkey % 4 = 0"""
    return politics.uk_recipients(_sql(spark, sf_dir, rows))


def _uk_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = """
    SELECT lpad(CAST(c_custkey AS STRING), 8, '0') AS company_number, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS company_name,
           'Title ' || c_mktsegment AS title, CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'dissolved' END AS company_status,
           '2001-02-' || lpad(CAST(c_nationkey + 1 AS STRING), 2, '0') AS date_of_creation,
           CASE WHEN c_custkey % 2 = 1 THEN '2011-12-13' END AS date_of_cessation,
           named_struct('po_box', CASE WHEN c_custkey % 7 = 0 THEN 'Box 1' END, 'premises', CAST(c_custkey % 90 AS STRING),
                        'address_line_1', 'Main Road', 'address_line_2', '', 'locality', c_mktsegment, 'region', CAST(NULL AS STRING),
                        'postal_code', 'AB' || CAST(c_nationkey AS STRING)) AS registered_office_address,
           CASE WHEN c_custkey % 5 = 0 THEN array('A', 'B') WHEN c_custkey % 5 = 1 THEN array_repeat('x', 0) END AS previous_company_names
    FROM {customer}"""
    return companies.uk_companies(_sql(spark, sf_dir, rows))


def _uk_officers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = """
    SELECT lpad(CAST(o_custkey AS STRING), 8, '0') AS company_number, 'Officer ' || CAST(o_orderkey % 500 AS STRING) AS name, 'Firm' AS company_name,
           CASE WHEN o_orderstatus = 'F' THEN 'director' ELSE 'secretary' END AS officer_role,
           date_format(o_orderdate, 'yyyy-MM-dd') AS appointed_on, CASE WHEN o_orderstatus = 'P' THEN '2003-01-02' END AS resigned_on,
           named_struct('officer', named_struct('appointments',
               CASE WHEN o_orderkey % 9 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 9 = 1 THEN '/officers/none'
                    ELSE '/officers/o' || CAST(o_orderkey % 500 AS STRING) || '/appointments' END)) AS links
    FROM {orders}"""
    return companies.uk_officers(_sql(spark, sf_dir, rows))


def _lei_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = """
    SELECT named_struct('lei', CAST(c_custkey AS STRING), 'entity', named_struct(
               'jurisdiction', CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'us-de' ELSE 'NO' END,
               'status', 'ACTIVE', 'creationDate', date_format(DATE '2000-01-01' + CAST(c_nationkey AS INT), 'yyyy-MM-dd') || 'T10:00:00Z',
               'legalName', named_struct('name', c_name),
               'expiration', named_struct('reason', CASE WHEN c_custkey % 2 = 0 THEN 'DISSOLVED' ELSE 'CORPORATE_ACTION' END, 'date', '2015-06-07'),
               'legalAddress', named_struct('addressLines', CASE WHEN c_custkey % 4 > 0 THEN array('Line 1', '', c_mktsegment) END,
                    'postalCode', CASE WHEN c_custkey % 8 > 0 THEN '01' END, 'city', CASE WHEN c_custkey % 8 > 0 THEN 'Town' END, 'country', 'se'))) AS attributes,
           named_struct('self', 'https://lei.example/' || CAST(c_custkey AS STRING)) AS links
    FROM {customer}"""
    return companies.lei_companies(_sql(spark, sf_dir, rows))


def _no_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = """
    SELECT CAST(c_custkey AS STRING) AS organisasjonsnummer, c_name AS navn, c_custkey % 5 = 0 AS konkurs,
           CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 END AS underAvvikling, c_custkey % 7 = 0 AS underTvangsavviklingEllerTvangsopplosning,
           CASE WHEN c_custkey % 2 = 0 THEN '1999-12-31' ELSE '' END AS stiftelsesdato, '2000-02-03' AS registreringsdatoEnhetsregisteret,
           CASE WHEN c_custkey % 4 = 0 THEN array(named_struct('navn', 'Old'), named_struct('navn', 'Older')) END AS historiskeNavn,
           named_struct('adresse', CASE WHEN c_custkey % 6 > 0 THEN array('Gate ' || CAST(c_nationkey AS STRING)) END,
                        'postnummer', CASE WHEN c_custkey % 6 <> 1 THEN '0150' END, 'poststed', CASE WHEN c_custkey % 6 > 1 THEN 'OSLO' END) AS forretningsadresse,
           named_struct('self', named_struct('href', 'h' || CAST(c_custkey AS STRING))) AS _links
    FROM {customer}"""
    return companies.no_companies(_sql(spark, sf_dir, rows))


LANDED_COMPANY_QUERIES: dict[str, Query] = {
    "landed.us_recipients": _us_recipients,
    "landed.uk_recipients": _uk_recipients,
    "landed.uk_companies": _uk_companies,
    "landed.uk_officers": _uk_officers,
    "landed.lei_companies": _lei_companies,
    "landed.no_companies": _no_companies,
}

LANDED_COMPANY_ORACLES: dict[str, str] = {
    "landed.us_recipients": """
SELECT CAST(c_custkey AS VARCHAR) AS recipient_id, c_name AS name,
    CASE WHEN c_custkey % 3 <> 0 THEN DATE '2020-01-01' + c_nationkey::INTEGER WHEN c_custkey % 6 <> 0 THEN DATE '2019-05-04' END AS registered_date
FROM customer""",
    "landed.uk_recipients": """
SELECT CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS recipient_id, c_name AS name,
    CASE WHEN c_custkey % 5 <> 0 THEN DATE '2011-11-01' + c_nationkey::INTEGER END AS registered_date
FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 4 = 0""",
    "landed.uk_companies": """
SELECT 'gb:' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS company_id, 'GB' AS jurisdiction,
    CASE WHEN c_custkey % 3 = 0 THEN 'Title ' || c_mktsegment ELSE c_name END AS name,
    CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'dissolved' END AS status, DATE '2001-02-01' + c_nationkey::INTEGER AS incorporation_date,
    CASE WHEN c_custkey % 2 = 1 THEN DATE '2011-12-13' END AS dissolution_date,
    CASE WHEN c_custkey % 7 = 0 THEN 'Box 1, ' ELSE '' END || (c_custkey % 90) || ', Main Road, ' || c_mktsegment || ', AB' || c_nationkey AS registered_address,
    CASE WHEN c_custkey % 5 = 0 THEN 2 WHEN c_custkey % 5 = 1 THEN 0 END AS previous_name_count,
    'https://find-and-update.company-information.service.gov.uk/company/' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS source_url
FROM customer""",
    "landed.uk_officers": """
SELECT 'gb:' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS company_id, CASE WHEN o_orderkey % 9 > 1 THEN 'o' || (o_orderkey % 500) END AS officer_id,
    'Officer ' || (o_orderkey % 500) AS name, 'Firm' AS company_name, CASE WHEN o_orderstatus = 'F' THEN 'director' ELSE 'secretary' END AS role,
    CAST(o_orderdate AS DATE) AS appointed_on, CASE WHEN o_orderstatus = 'P' THEN DATE '2003-01-02' END AS resigned_on
FROM orders""",
    "landed.lei_companies": """
SELECT 'lei:' || c_custkey AS company_id, CASE c_custkey % 3 WHEN 0 THEN 'SE' WHEN 1 THEN 'US' ELSE 'NO' END AS jurisdiction, c_name AS name,
    'ACTIVE' AS status, DATE '2000-01-01' + c_nationkey::INTEGER AS incorporation_date,
    CASE WHEN c_custkey % 2 = 0 THEN DATE '2015-06-07' END AS dissolution_date,
    nullif(concat_ws(', ', CASE WHEN c_custkey % 4 > 0 THEN 'Line 1, ' || c_mktsegment END, CASE WHEN c_custkey % 8 > 0 THEN '01, Town' END), '') AS registered_address,
    CAST(NULL AS BIGINT) AS previous_name_count, 'https://lei.example/' || c_custkey AS source_url
FROM customer""",
    "landed.no_companies": """
SELECT 'no:' || c_custkey AS company_id, 'NO' AS jurisdiction, c_name AS name,
    CASE WHEN c_custkey % 5 = 0 THEN 'bankrupt' WHEN c_custkey % 6 = 0 OR c_custkey % 7 = 0 THEN 'in_liquidation' ELSE 'active' END AS status,
    CASE WHEN c_custkey % 2 = 0 THEN DATE '1999-12-31' ELSE DATE '2000-02-03' END AS incorporation_date, CAST(NULL AS DATE) AS dissolution_date,
    nullif(concat_ws(', ', CASE WHEN c_custkey % 6 > 0 THEN 'Gate ' || c_nationkey END,
        CASE c_custkey % 6 WHEN 0 THEN '0150' WHEN 1 THEN NULL ELSE '0150 OSLO' END), '') AS registered_address,
    CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END AS previous_name_count, 'h' || c_custkey AS source_url
FROM customer""",
}
