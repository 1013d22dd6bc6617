"""Contract tables as SQL views over the test tables.

The text is portable SQL: ``spark.sql`` runs it on DataFrames, and the same
text is a common table expression for the SQL check. Every view covers its
whole source tables. CASE expressions add the skew that makes default
thresholds fire (one judge, one supplier and one funder hold large shares).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from leadspark.sources.contracts import load_contract

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

# 10592 days move 1995-01-01 to 2024-01-01.
_FILED = "CAST(o.o_orderdate AS DATE) + 10592"

BINDINGS: dict[str, str] = {
    # ------------------------------------------------------------------ campaign finance
    "donations": """
        SELECT CAST(o.o_orderkey AS STRING) AS donation_id,
               CASE WHEN o.o_custkey % 10 = 0 THEN 'S' || CAST(o.o_custkey AS STRING)
                    ELSE 'R' || CAST(o.o_custkey % 8 AS STRING) END AS recipient_id,
               CASE WHEN o.o_custkey % 10 = 0 THEN 'Committee ' || CAST(o.o_custkey AS STRING)
                    ELSE 'Party ' || CAST(o.o_custkey % 8 AS STRING) END AS recipient_name,
               CASE WHEN o.o_custkey % 10 = 0 AND o.o_orderkey % 20 = 0 THEN 'Another donor'
                    ELSE ' Donor ' || CAST(o.o_custkey % 60 AS STRING) END AS donor_name,
               CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'Retired'
                    WHEN c.c_mktsegment = 'MACHINERY' THEN ' '
                    ELSE ' ' || lower(c.c_mktsegment) || ' ' END AS donor_employer,
               CASE WHEN o.o_custkey % 60 % 7 = 6 THEN NULL
                    ELSE 'ab' || CAST(o.o_custkey % 60 % 7 AS STRING) || ' 1xy' END AS donor_postcode,
               o.o_totalprice / 100.0 AS amount,
               CAST(o.o_orderdate AS DATE) AS donation_date
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    "recipients": """
        SELECT CASE WHEN o_custkey % 10 = 0 THEN 'S' || CAST(o_custkey AS STRING)
                    ELSE 'R' || CAST(o_custkey % 8 AS STRING) END AS recipient_id,
               min(CASE WHEN o_custkey % 10 = 0 THEN 'Committee ' || CAST(o_custkey AS STRING)
                        ELSE 'Party ' || CAST(o_custkey % 8 AS STRING) END) AS name,
               max(CAST(o_orderdate AS DATE)) - 400 AS registered_date
        FROM {orders}
        GROUP BY CASE WHEN o_custkey % 10 = 0 THEN 'S' || CAST(o_custkey AS STRING)
                      ELSE 'R' || CAST(o_custkey % 8 AS STRING) END""",
    # ------------------------------------------------------------------ companies
    "companies": """
        SELECT 'gb:' || CAST(c.c_custkey AS STRING) AS company_id,
               CASE WHEN c.c_nationkey % 5 = 0 THEN 'us' ELSE 'gb' END AS jurisdiction,
               c.c_name AS name,
               CASE WHEN c.c_custkey % 3 = 0 THEN 'dissolved' ELSE 'active' END AS status,
               max(CAST(o.o_orderdate AS DATE)) - CAST(c.c_custkey % 900 AS INT) AS incorporation_date,
               CASE WHEN c.c_custkey % 3 = 0 THEN max(CAST(o.o_orderdate AS DATE)) END AS dissolution_date,
               CASE WHEN c.c_custkey % 2 = 0 THEN CAST(c.c_custkey % 20 AS STRING) || ', Élan Street'
                    ELSE CAST(c.c_custkey % 20 AS STRING) || ' ÉLAN-STREET.' END AS registered_address,
               CAST(c.c_custkey % 10 AS BIGINT) AS previous_name_count,
               'https://register.example/' || CAST(c.c_custkey AS STRING) AS source_url
        FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey
        GROUP BY c.c_custkey, c.c_nationkey, c.c_name""",
    "company_officers": """
        SELECT 'gb:' || CAST(l_orderkey AS STRING) AS company_id,
               'O' || CAST(l_suppkey AS STRING) AS officer_id,
               'Officer ' || CAST(l_suppkey AS STRING) AS name,
               CASE WHEN l_linenumber = 1 THEN NULL ELSE 'Company ' || CAST(l_orderkey AS STRING) END AS company_name,
               CASE WHEN l_returnflag = 'A' THEN 'revi' WHEN l_returnflag = 'N' THEN NULL ELSE 'DIR' END AS role,
               CASE WHEN l_linestatus = 'F' AND l_linenumber > 3 THEN CAST(l_shipdate AS DATE) END AS resigned_on
        FROM {lineitem}""",
    "company_controllers": """
        SELECT 'gb:' || CAST(c_custkey AS STRING) AS company_id,
               'X' || CAST(c_custkey % 13 AS STRING) AS controller_id,
               'Holder ' || CAST(c_custkey % 13 AS STRING) AS controller_name,
               CASE WHEN c_custkey % 7 = 0 THEN 'statement' WHEN c_custkey % 7 = 1 THEN 'individual'
                    ELSE 'legal_entity' END AS controller_kind,
               CASE WHEN c_custkey % 3 = 0 THEN 'pa ' WHEN c_custkey % 3 = 1 THEN 'US' ELSE 'FR' END AS controller_country,
               CASE WHEN c_custkey % 10 < 4 THEN 'gb:' || CAST(c_custkey - c_custkey % 10 + (c_custkey % 10 + 1) % 4 AS STRING)
                    WHEN c_custkey % 10 = 4 THEN 'gb:' || CAST(c_custkey AS STRING)
                    WHEN c_custkey % 10 = 9 THEN NULL
                    ELSE 'gb:' || CAST(c_custkey + 1 AS STRING) END AS controller_company_id,
               CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS control_type,
               DATE '2010-01-01' + CAST(c_custkey % 1000 AS INT) AS notified_on,
               CASE WHEN c_custkey % 50 = 3 THEN DATE '2015-01-01' END AS ceased_on
        FROM {customer}
        UNION ALL
        SELECT 'gb:' || CAST(c_custkey AS STRING), 'Y' || CAST(c_nationkey AS STRING), 'Second holder', 'legal_entity',
               'KY',
               CASE WHEN c_custkey % 10 = 2 THEN 'gb:' || CAST(c_custkey - 1 AS STRING)
                    ELSE 'gb:' || CAST(c_custkey + 7 AS STRING) END,
               'votes', DATE '2012-01-01', NULL
        FROM {customer}""",
    # ------------------------------------------------------------------ court
    "court_cases": """
        SELECT 'K' || CAST(o_orderkey AS STRING) AS case_id,
               o_orderpriority AS court_id,
               'Case ' || CAST(o_orderkey AS STRING) AS case_name,
               'D-' || CAST(o_custkey AS STRING) AS docket_number,
               CAST(o_orderdate AS DATE) AS date_filed,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 1400 AS INT) END AS date_terminated,
               CASE WHEN o_orderstatus = 'O' THEN 'Contract' WHEN o_orderstatus = 'F' THEN 'Tort' END AS nature_of_suit,
               CASE WHEN o_custkey % 2 = 0 THEN 'North' END AS division,
               CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 20 <> 0 THEN 'J1'
                    WHEN o_orderkey % 97 = 0 THEN NULL
                    ELSE 'J' || CAST(o_custkey % 20 AS STRING) END AS assigned_judge_id,
               CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 20 <> 0 THEN 'Judge 1'
                    WHEN o_orderkey % 97 = 0 THEN NULL
                    ELSE 'Judge ' || CAST(o_custkey % 20 AS STRING) END AS assigned_judge_name,
               'https://court.example/' || CAST(o_orderkey AS STRING) AS url
        FROM {orders}""",
    "case_parties": """
        SELECT 'K' || CAST(l.l_orderkey AS STRING) AS case_id,
               CASE WHEN p.p_size % 11 = 0 THEN 'United States of America'
                    ELSE p.p_brand || CASE WHEN l.l_linenumber % 2 = 0 THEN ' Holdings (US), Inc.' ELSE ' Company' END
                    END AS party_name,
               CASE WHEN l.l_linenumber = 1 THEN NULL WHEN l.l_linenumber % 3 = 0 THEN 'Defendant'
                    ELSE 'Plaintiff' END AS party_role
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "case_counsel": """
        SELECT 'K' || CAST(l_orderkey AS STRING) AS case_id,
               'Counsel ' || CAST(l_suppkey AS STRING) AS counsel_name,
               CASE WHEN l_returnflag = 'N' THEN NULL
                    ELSE 'Firm ' || CAST(l_suppkey % 10 AS STRING) || ' Partners LLP' END AS firm_name
        FROM {lineitem}""",
    "judge_interests": """
        SELECT 'J' || CAST(p_partkey % 20 AS STRING) AS judge_id,
               'Judge ' || CAST(p_partkey % 20 AS STRING) AS judge_name,
               1995 + p_partkey % 7 AS report_year,
               CASE WHEN p_size % 3 = 0 THEN 'Investment' WHEN p_size % 3 = 1 THEN 'gift' ELSE 'Reimbursement' END AS interest_type,
               CASE WHEN p_size % 3 = 0 THEN p_brand || CASE WHEN p_size % 2 = 0 THEN ' Holdings Corp. Common Stock' ELSE '' END
                    WHEN p_size % 6 = 1 THEN 'Firm ' || CAST(p_partkey % 10 AS STRING)
                    ELSE p_name END AS counterparty,
               p_type AS description,
               p_retailprice AS value_low,
               p_retailprice * 2.0 AS value_high,
               'https://reports.example/' || CAST(p_partkey AS STRING) AS url
        FROM {part}""",
    # ------------------------------------------------------------------ lobbying
    "lobbying_registrations": f"""
        SELECT 'F' || CAST(o.o_orderkey AS STRING) AS registration_id,
               r.r_name AS register,
               CAST(date_trunc('quarter', {_FILED}) AS DATE) AS period_start,
               CASE WHEN {_FILED} > DATE '2030-04-15' AND o.o_custkey % 20 = 0 THEN 'N' || CAST(o.o_custkey AS STRING)
                    ELSE 'L' || CAST(o.o_custkey % 150 AS STRING) END AS registrant_id,
               'Registrant ' || CAST(o.o_custkey % 150 AS STRING) || ' & Sons, Inc.' AS registrant_name,
               CASE WHEN o.o_custkey % 150 % 10 = 0 THEN 'C' || CAST(o.o_custkey % 150 AS STRING)
                    WHEN o.o_custkey % 4 = 1 THEN NULL
                    ELSE 'C' || CAST(o.o_custkey % 900 AS STRING) END AS client_id,
               CASE WHEN o.o_custkey % 25 = 3 THEN 'Apollo Global ' || CAST(o.o_custkey % 5 AS STRING)
                    WHEN o.o_custkey % 25 = 4 THEN 'Republic of Ruritania'
                    WHEN o.o_custkey % 25 = 5 THEN 'Global Public Benefit Corp'
                    WHEN o.o_custkey % 25 = 6 THEN NULL
                    ELSE c.c_name END AS client_name,
               CASE WHEN n.n_nationkey < 10 THEN ' us'
                    WHEN n.n_nationkey % 7 = 0 THEN 'US' ELSE n.n_name END AS client_country,
               CASE WHEN o.o_custkey % 7 = 0 OR o.o_orderkey % 6 = 5 THEN NULL ELSE o.o_totalprice END AS spend_low,
               CASE WHEN o.o_custkey % 7 = 0 OR o.o_orderkey % 6 = 5 THEN NULL
                    WHEN o.o_orderkey % 9 = 0 THEN o.o_totalprice * 2.0 ELSE o.o_totalprice END AS spend_high,
               o.o_orderpriority || ' | ' || o.o_orderstatus || '|' AS issue_area,
               CASE WHEN o.o_orderkey % 6 = 5 THEN 'RR' WHEN o.o_orderkey % 6 = 4 THEN NULL
                    ELSE 'Q' || CAST(o.o_orderkey % 6 + 1 AS STRING) END AS filing_type,
               'https://lobby.example/' || CAST(o.o_orderkey AS STRING) AS url,
               CASE WHEN o.o_custkey % 6 = 0 THEN 'A Sovereign and established government' ELSE 'Trade body' END AS client_description,
               CASE WHEN o.o_custkey % 3 = 0 THEN 'US' WHEN o.o_custkey % 3 = 1 THEN NULL ELSE 'FR' END AS client_ppb_country,
               CASE WHEN o.o_custkey % 12 = 0 THEN 'a/b/c' WHEN o.o_custkey % 12 = 1 THEN 'Poster LLC' ELSE 'Clerk' END AS posted_by_name
        FROM {{orders}} o
        JOIN {{customer}} c ON c.c_custkey = o.o_custkey
        JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey
        JOIN {{region}} r ON r.r_regionkey = n.n_regionkey""",
    "lobbyists": """
        SELECT 'F' || CAST(l_orderkey AS STRING) AS registration_id,
               'Y' || CAST(l_suppkey AS STRING) AS lobbyist_id,
               'Lobbyist ' || CAST(l_suppkey AS STRING) AS name,
               CASE WHEN l_partkey % 12 = 0 THEN 'Counsel, Senate Armed Services Committee'
                    WHEN l_partkey % 12 = 1 THEN 'Staff, House Ways and Means'
                    WHEN l_partkey % 12 = 2 THEN 'Clerk, Senate Finance Committee'
                    WHEN l_partkey % 12 = 3 THEN 'Aide, House Energy & Commerce'
                    WHEN l_partkey % 12 = 4 THEN 'Fellow, Senate Veterans Affairs'
                    WHEN l_partkey % 12 = 5 THEN 'Queen and Head of State'
                    WHEN l_partkey % 12 = 6 THEN ' n/a '
                    WHEN l_partkey % 12 = 7 THEN 'Not Applicable'
                    WHEN l_partkey % 12 = 8 THEN NULL
                    ELSE 'Judiciary health analyst' END AS former_public_office,
               CASE WHEN l_suppkey % 6 = 0 THEN ' Ministry of Signup '
                    WHEN l_suppkey % 6 = 1 THEN 'the great ministry of click and more'
                    WHEN l_suppkey % 6 = 2 THEN 'error'
                    WHEN l_suppkey % 6 = 3 THEN 'Ministry'
                    WHEN l_suppkey % 6 = 4 THEN 'ab' END AS former_office_institution,
               CASE WHEN l_suppkey % 5 = 0 THEN NULL
                    WHEN l_suppkey % 13 = 0 AND l_linenumber = 6 THEN DATE '2024-01-20'
                    ELSE DATE '2017-06-01' + CAST(l_suppkey % 97 * 24 AS INT) END AS former_office_end
        FROM {lineitem}""",
    "lobbying_contacts": """
        SELECT 'T' || CAST(event_id - event_id % 2 AS STRING) AS contact_id,
               'L' || CAST(user_id % 150 AS STRING) AS registrant_id,
               'Registrant ' || CAST(user_id % 150 AS STRING) AS registrant_name,
               CAST(ts AS DATE) + CAST(CASE WHEN event_id % 3 = 0 THEN (event_id % 17) * 30 ELSE 0 END AS INT) AS contact_date,
               CASE WHEN event_id % 10 = 9 THEN NULL ELSE 'Official ' || CAST(event_id % 40 AS STRING) END AS official_name,
               CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Ministry of ' || event_type END AS institution
        FROM {events}""",
    "lobbying_foreign_entities": """
        SELECT 'F' || CAST(l_orderkey AS STRING) AS registration_id,
               'Entity ' || CAST(l_suppkey AS STRING) AS foreign_entity_name,
               CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'Country ' || CAST(l_suppkey % 30 AS STRING) END AS country,
               'Country ' || CAST(l_partkey % 30 AS STRING) AS ppb_country
        FROM {lineitem}""",
    "lobbying_activities": """
        SELECT 'F' || CAST(l_orderkey AS STRING) AS registration_id,
               CASE WHEN l_partkey % 8 = 0 THEN 'DEF' WHEN l_partkey % 8 = 1 THEN 'TAX' WHEN l_partkey % 8 = 2 THEN 'HCR'
                    WHEN l_partkey % 8 = 3 THEN 'BUD' WHEN l_partkey % 8 = 4 THEN 'ENG' ELSE 'XYZ' END AS general_issue_code,
               CASE WHEN l_partkey % 40 = 0 THEN 'Talks on SANCTIONS and trade'
                    WHEN l_partkey % 40 = 1 THEN 'By order of the Empress'
                    WHEN l_partkey % 40 = 2 THEN 'the seal reads Annuit'
                    WHEN l_partkey % 40 = 3 THEN 'Coeptis and more'
                    WHEN l_partkey % 40 = 4 THEN NULL
                    WHEN l_partkey % 40 = 5 THEN 'meeting a foreign'
                    WHEN l_partkey % 40 = 6 THEN 'government delegate'
                    ELSE 'Issue ' || CAST(l_partkey % 90 AS STRING) END AS description,
               CAST(l_linenumber AS BIGINT) AS activity_index
        FROM {lineitem}""",
    "political_contributions": """
        SELECT 'F' || CAST(l_orderkey AS STRING) AS registration_id,
               CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE 'Payee ' || CAST(l_suppkey % 50 AS STRING) END AS payee_name,
               CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 'Honoree ' || CAST(l_partkey % 7 AS STRING) END AS honoree_name,
               CASE WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice END AS amount,
               'Contributor ' || CAST(l_partkey % 80 AS STRING) AS contributor_name
        FROM {lineitem}""",
    "foreign_agent_registrants": """
        SELECT 'REGISTRANT ' || CAST(s_suppkey AS STRING) || ' and Sons Inc' AS registrant_name FROM {supplier}""",
    "legislators": """
        SELECT 'G' || CAST(n_nationkey AS STRING) AS bioguide_id, 'Member ' || n_name AS name,
               CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS party, n_name AS state
        FROM {nation}""",
    "committee_assignments": """
        SELECT 'G' || CAST(n.n_nationkey AS STRING) AS bioguide_id,
               CASE WHEN n.n_regionkey = 0 THEN 'Senate Committee on Finance' WHEN n.n_regionkey = 1 THEN 'Subcommittee on Finance Rules'
                    ELSE 'Committee on ' || r.r_name END AS committee_name,
               'Member' AS role
        FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey""",
    "press_releases": """
        SELECT 'G' || CAST(doc_id % 25 AS STRING) AS bioguide_id, DATE '2024-03-01' AS date,
               'Member ' || CAST(doc_id % 25 AS STRING) AS member_name,
               CASE WHEN doc_id % 5 = 0 THEN text || ' Apollo, a Private Equity firm' ELSE text END AS text,
               source AS title, 'https://press.example/' || CAST(doc_id AS STRING) AS url
        FROM {documents}""",
    # ------------------------------------------------------------------ parliamentary
    "parl_members": """
        SELECT 'M' || CAST(s_suppkey AS STRING) AS member_id,
               CASE WHEN s_suppkey % 2 = 0 THEN 'east' ELSE 'west' END AS parliament,
               s_name AS name, CAST(s_nationkey AS STRING) AS country
        FROM {supplier}""",
    "parl_votings": """
        SELECT CAST(year(l_shipdate) * 1000 + month(l_shipdate) * 10 + CAST(floor(day(l_shipdate) / 8.0) AS INT) AS STRING) AS voting_id,
               CASE WHEN l_suppkey % 2 = 0 THEN 'east' ELSE 'west' END AS parliament,
               CASE WHEN month(l_shipdate) % 2 = 0 THEN 'upper' END AS chamber,
               min(CAST(l_shipdate AS DATE)) AS vote_date
        FROM {lineitem} GROUP BY 1, 2, 3""",
    "parl_member_votes": """
        SELECT v.voting_id, v.parliament, v.member_id,
               CASE WHEN v.pick % 10 = 7 OR (v.suppkey % 10 = 3 AND v.pick % 3 = 0) THEN 'ABSENT'
                    WHEN v.pick % 23 = 5 THEN 'abstain'
                    WHEN v.suppkey % 9 = 4 AND v.pick % 2 = 0 THEN 'Against'
                    WHEN v.suppkey % 14 = 6 AND v.quarter % 2 = 0 AND v.pick % 4 <> 0 THEN 'against'
                    WHEN v.pick % 31 = 1 THEN 'excused'
                    ELSE 'For' END AS position,
               CASE WHEN v.suppkey % 12 = 11 THEN 'NI' WHEN v.suppkey % 12 = 10 THEN NULL
                    ELSE 'Group ' || CAST(v.suppkey % 5 AS STRING) END AS group_at_vote
        FROM (SELECT CAST(year(l_shipdate) * 1000 + month(l_shipdate) * 10 + CAST(floor(day(l_shipdate) / 8.0) AS INT) AS STRING) AS voting_id,
                     CASE WHEN l_suppkey % 2 = 0 THEN 'east' ELSE 'west' END AS parliament,
                     'M' || CAST(l_suppkey AS STRING) AS member_id,
                     l_suppkey AS suppkey,
                     min(l_orderkey) AS pick,
                     min(year(l_shipdate) * 4 + CAST(floor((month(l_shipdate) - 1) / 3.0) AS INT)) AS quarter
              FROM {lineitem} GROUP BY 1, 2, 3, 4) v""",
    "parl_affiliations": """
        SELECT 'M' || CAST(o_custkey % 400 AS STRING) AS member_id,
               CASE WHEN o_custkey % 2 = 0 THEN 'east' ELSE 'west' END AS parliament,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'party' ELSE 'group' END AS affiliation_type,
               CASE WHEN o_orderstatus = 'O' THEN 'Greens ' WHEN o_orderstatus = 'F' THEN 'greens' ELSE 'Left' END AS org_name,
               CAST(o_orderdate AS DATE) AS start_date,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 90 END AS end_date,
               CASE WHEN year(o_orderdate) = 1997 THEN NULL ELSE CAST(year(o_orderdate) AS STRING) END AS term
        FROM {orders}""",
    "parl_interests": """
        SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) AS interest_id,
               'M' || CAST(l_suppkey AS STRING) AS member_id,
               CASE WHEN l_suppkey % 2 = 0 THEN 'east' ELSE 'west' END AS parliament,
               'Organisation ' || CAST(l_partkey AS STRING) AS organisation,
               CASE WHEN l_returnflag = 'A' THEN 'Paid' WHEN l_returnflag = 'N' THEN 'unpaid' END AS paid,
               CASE WHEN l_linestatus = 'O' THEN l_extendedprice END AS income_high,
               CASE WHEN l_quantity > 20 THEN CAST(l_shipdate AS DATE) END AS end_date
        FROM {lineitem}""",
    # ------------------------------------------------------------------ procurement
    "procurement_processes": """
        SELECT 'P' || CAST(o_orderkey AS STRING) AS process_id,
               CASE WHEN o_custkey % 50 = 49 THEN NULL ELSE 'B' || CAST(o_custkey % 50 AS STRING) END AS buyer_id,
               'Buyer ' || CAST(o_custkey % 50 AS STRING) AS buyer_name,
               'XX' AS country,
               CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'C' || CAST(o_orderkey % 3 AS STRING) END AS category_code,
               CASE WHEN o_custkey % 50 < 12 AND o_orderkey % 3 <> 0 THEN 'Direct'
                    WHEN o_orderpriority = '1-URGENT' THEN 'limited' WHEN o_orderpriority = '2-HIGH' THEN 'Open'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'selective' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
                    ELSE 'open' END AS procurement_method,
               CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS tender_value,
               CASE WHEN o_custkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
               CAST(o_orderdate AS DATE) AS tender_published_date,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL
                    ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 2 AS INT) END AS tender_deadline,
               o_orderkey % 7 AS number_of_tenderers
        FROM {orders}""",
    "procurement_awards": """
        SELECT 'A' || CAST(l_orderkey AS STRING) AS award_id,
               'P' || CAST(l_orderkey AS STRING) AS process_id,
               CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'S-main'
                    ELSE 'S' || CAST(l_suppkey AS STRING) END AS supplier_id,
               CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'Main supplier'
                    ELSE 'Supplier ' || CAST(l_suppkey AS STRING) END AS supplier_name,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS award_value,
               CASE WHEN l_returnflag = 'A' THEN NULL ELSE 'EUR' END AS currency,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS award_date,
               CASE WHEN l_linenumber = 7 THEN l_extendedprice * 2.0
                    WHEN l_linenumber = 1 THEN l_extendedprice * (1.0 + l_tax * 5.0) END AS final_value
        FROM {lineitem}""",
}


def base_tables(binding: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", BINDINGS[binding])))


def bind(spark: SparkSession, sf_dir: str, *tables: str) -> list[DataFrame]:
    """Contract tables over the test tables of a folder, cast to their contracts."""
    bound = []
    for table in tables:
        sources = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in base_tables(table)}
        bound.append(load_contract(spark.sql(BINDINGS[table], **sources), table))
    return bound


def sql_views(*tables: str) -> str:
    """The same tables as common table expressions, without the WITH keyword."""
    parts = []
    for table in tables:
        body = BINDINGS[table].format(**{name: name for name in base_tables(table)})
        parts.append(f"{table} AS ({body})")
    return ",\n".join(parts)
