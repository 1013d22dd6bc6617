"""Landed raw records become contract rows."""

import datetime as dt
import json

from leadspark.sources.landed import companies, court, lobbying, parliament, politics, procurement, statistics


def read_json(spark, tmp_path, schema, records):
    file = tmp_path / "records.jsonl"
    n = 0
    while file.exists():
        n += 1
        file = tmp_path / f"records{n}.jsonl"
    file.write_text("\n".join(json.dumps(record) for record in records), encoding="utf-8")
    return spark.read.schema(schema).json(str(file))


def rows(df, *columns):
    return sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)


def test_us_filings(spark, tmp_path):
    person = {"lobbyist": {"id": 7, "first_name": "Ada", "last_name": "Lo"}, "covered_position": " Clerk "}
    filings = read_json(
        spark, tmp_path, lobbying.US_FILING,
        [
            {
                "filing_uuid": "u1", "filing_type": "Q1", "filing_year": 2025, "filing_period": "first_quarter",
                "income": "1000.50", "expenses": "7", "registrant": {"id": 1, "name": "R"},
                "client": {"id": 2, "name": "C", "country": " FR ", "client_self_select": False},
                "lobbying_activities": [
                    {"general_issue_code": "TAX", "description": "a", "lobbyists": [person]},
                    {"general_issue_code": "DEF", "description": " ", "lobbyists": [person, {**person, "covered_position": None}]},
                    {"general_issue_code": "TAX", "description": "c", "lobbyists": None},
                ],
                "foreign_entities": [{"name": "E", "country": "DE", "ppb_country": ""}],
            },
            {
                "filing_uuid": "u2", "filing_year": 2024, "filing_period": "other", "income": None, "expenses": "30",
                "registrant": {"id": 1, "name": "R"}, "client": {"id": 1, "name": "R", "client_self_select": True},
            },
        ],
    )
    found = rows(
        lobbying.us_registrations(filings),
        "registration_id", "period_start", "period_end", "client_id", "client_country", "spend_low", "issue_area",
    )
    assert found == [
        ("u1", dt.date(2025, 1, 1), dt.date(2025, 3, 31), "2", "FR", 1000.5, "TAX|DEF"),
        ("u2", dt.date(2024, 1, 1), dt.date(2024, 12, 31), None, None, 30.0, None),
    ]
    assert rows(lobbying.us_lobbyists(filings), "registration_id", "lobbyist_id", "name", "former_public_office") == [
        ("u1", "7", "Ada Lo", "Clerk"),
        ("u1", "7", "Ada Lo", None),
    ]
    assert rows(lobbying.us_activities(filings), "activity_index", "description") == [(0, "a"), (1, None), (2, "c")]
    assert rows(lobbying.us_foreign_entities(filings), "foreign_entity_name", "ppb_country") == [("E", None)]
    reports = read_json(
        spark, tmp_path, lobbying.US_CONTRIBUTION_REPORT,
        [{"filing_uuid": "k", "contribution_items": [{"payee_name": "P", "honoree_name": " ", "amount": "12.5"}]}],
    )
    assert rows(lobbying.us_contributions(reports), "payee_name", "honoree_name", "amount") == [("P", None, 12.5)]


def csv(spark, header, *lines):
    return spark.createDataFrame([dict(zip(header.split(), line, strict=True)) for line in lines], ", ".join(f"{h} string" for h in header.split()))


def test_canada(spark):
    registrations = csv(
        spark,
        "REG_ID_ENR REG_TYPE_ENR EFFECTIVE_DATE_VIGUEUR END_DATE_FIN EN_CLIENT_NM_AN FR_CLIENT_NM CLIENT_NUM "
        "RGSTRNT_NUM_DECLARANT RGSTRNT_1ST_NM_PRENOM_DCLRNT RGSTRNT_LAST_NM_DCLRNT CLIENT_PROFILE_ID_PROFIL_CLIENT",
        ("1", "1", "2024-02-03", "", "Acme", "", "9", "55", "Al", "Bo", "p1"),
        ("2", "3", "2024-02-04", "", "", "Bureau", "8", "56", "Cy", "", "p2"),
    )
    codes = csv(spark, "SUBJECT_CODE_OBJET SMT_EN_DESC", ("SMT-1", "Taxes"), ("SMT-2", "Health"))
    subjects = csv(
        spark, "REG_ID_ENR SUBJECT_CODE_OBJET ASSOC_SUBJECT_CODES_OBJET",
        ("1", "SMT-1", "SMT-2, SMT-1"), ("1", "SMT-7", ""),
    )
    found = lobbying.ca_registrations(registrations, [subjects], codes)
    assert rows(found, "registration_id", "registrant_id", "registrant_name", "client_id", "issue_area") == [
        ("1", "55", "Al Bo", "9", "Health|SMT-7|Taxes"),
        ("2", "org-8", "Bureau", None, None),
    ]
    consultants = csv(
        spark,
        "RGSTRNT_NUM_DECLARANT CLIENT_PROFILE_ID_PROFIL_CLIENT LBBYST_ID_LBBYST LBBYST_1ST_NM_PRENOM_LBBYST LBBYST_LAST_NM_LBBYST",
        ("55", "p1", "L1", "Al", "Bo"),
    )
    in_house = csv(
        spark, "CLIENT_PROFILE_ID_PROFIL_CLIENT LBBYST_ID_LBBYST LBBYST_FIRST_NM_PRENOM_LBBYST LBBYST_LAST_NM_LBBYST",
        ("p2", "L2", "Di", "Eo"),
    )
    offices = spark.createDataFrame(
        [("L1", "Clerk", "", "Senate", "2020-01-01", "")],
        "LOBBYIST_ID_LOBBYISTE string, TITLE_TITRE string, `POH_DETAILS _PRE_V5_INFO_TCP` string, INSTITUTION string, "
        "POS_END_DATE_FIN_POSTE string, DPOH_LAST_DATE_FIN_TCPD string",
    )
    people = lobbying.ca_lobbyists(registrations, consultants, in_house, offices)
    assert rows(people, "registration_id", "lobbyist_id", "former_office_institution", "former_office_end") == [
        ("1", "L1", "Senate", dt.date(2020, 1, 1)),
        ("2", "L2", None, None),
    ]
    reports = csv(
        spark,
        "COMLOG_ID PREV_COMLOG_ID_PRECEDNT COMM_DATE REG_TYPE_ENR REGISTRANT_NUM_DECLARANT CLIENT_ORG_CORP_NUM "
        "EN_CLIENT_ORG_CORP_NM_AN FR_CLIENT_ORG_CORP_NM RGSTRNT_1ST_NM_PRENOM_DCLRNT RGSTRNT_LAST_NM_DCLRNT",
        ("10", "", "2024-05-05", "1", "55", "9", "Acme", "", "Al", "Bo"),
        ("11", "10", "2024-05-06", "1", "55", "9", "Acme", "", "Al", "Bo"),
    )
    officials = csv(
        spark,
        "COMLOG_ID DPOH_FIRST_NM_PRENOM_TCPD DPOH_LAST_NM_TCPD DPOH_TITLE_TITRE_TCPD INSTITUTION OTHER_INSTITUTION_AUTRE",
        ("10", "X", "Y", "Min", "Finance", ""),
        ("11", "X", "Y", "Min", "Other", "Port Board"),
    )
    about = csv(spark, "COMLOG_ID SUBJECT_CODE_OBJET", ("11", "SMT-2"))
    contacts = lobbying.ca_contacts(reports, officials, about, codes)
    assert rows(contacts, "contact_id", "registrant_id", "institution", "subject", "contact_date") == [
        ("11", "55", "Port Board", "Health", dt.date(2024, 5, 6))
    ]


def test_european_union(spark, tmp_path):
    representative = {
        "identificationCode": "1-1", "registrationDate": "2020-05-05T00:00:00", "name": {"originalName": "Org"},
        "headOffice": {"country": "BELGIUM"}, "interests": {"interest": [{"name": "Trade"}, {"name": " "}]},
        "financialData": {"closedYear": {"startDate": "2023-01-01", "endDate": "2023-12-31",
                                         "costs": {"range": {"max": "10000"}}}},
    }
    firm = {
        **representative, "identificationCode": "2-2",
        "financialData": {"closedYear": {"startDate": "2023-01-01", "clients": {"client": [
            {"name": "A", "revenue": {"range": {"min": "10000", "max": "24999"}}},
            {"name": "B", "revenue": {"absoluteCost": "5"}}]}}},
    }
    table = read_json(spark, tmp_path, lobbying.EU_REPRESENTATIVE, [representative, firm])
    assert rows(
        lobbying.eu_registrations(table), "registration_id", "client_name", "client_country", "spend_low", "spend_high", "issue_area"
    ) == [
        ("1-1", None, "BELGIUM", 0.0, 10000.0, "Trade"),
        ("2-2", "A", None, 10000.0, 24999.0, "Trade"),
        ("2-2", "B", None, 5.0, 5.0, "Trade"),
    ]
    meeting = {
        "date": "2024-04-04", "dgname": "Trade", "dgacronym": "TRADE", "location": "Brussels", "subject": "s",
        "entities": {"entity": [{"id": "1-1", "name": "Org"}, {"id": "2-2", "name": "Firm"}]},
        "representatives": {"representative": [{"name": "Q", "title": "Head"}]},
    }
    met = lobbying.eu_contacts(read_json(spark, tmp_path, lobbying.EU_MEETING, [meeting, meeting]), "dg")
    assert rows(met, "registrant_id", "official_name", "institution") == [
        ("1-1", "Q", "Trade (TRADE)"),
        ("2-2", "Q", "Trade (TRADE)"),
    ]
    assert len({row.contact_id for row in met.collect()}) == 1


def test_eu_contacts_shuffle_meetings_only(spark, tmp_path):
    meeting = {
        "date": "2024-04-04", "cabinet": "C", "subject": "s",
        "entities": {"entity": [{"id": " 1-1", "name": "Org"}, {"id": "1-1", "name": "Org"}, {"id": "2-2"}]},
        "representatives": {"representative": [{"name": "Q"}, {"name": "Q"}, {"name": "R"}]},
    }
    other = {**meeting, "entities": {"entity": [{"id": "3-3", "name": "New"}]}, "representatives": {"representative": [{"name": "Q"}]}}
    empty = [{**meeting, "subject": "t", "entities": {"entity": []}}, {**meeting, "subject": "u", "representatives": None}]
    met = lobbying.eu_contacts(read_json(spark, tmp_path, lobbying.EU_MEETING, [meeting, other, meeting, *empty]), "dg")
    assert sorted((row.registrant_id, row.official_name) for row in met.collect()) == [
        ("1-1", "Q"), ("1-1", "R"), ("2-2", "Q"), ("2-2", "R"), ("3-3", "Q"),
    ]
    plan = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_us_politics(spark, tmp_path):
    one = json.dumps({"REGISTRANTS_ACTIVE": {"ROW": {"Name": " Solo "}}})
    two = json.dumps({"REGISTRANTS_ACTIVE": {"ROW": [{"Name": "A"}, {"Name": "B"}]}})
    documents = spark.createDataFrame([(one,), (two,), ("{}",)], "value string")
    assert rows(lobbying.us_foreign_agents(documents), "registrant_name") == [("A",), ("B",), ("Solo",)]
    people = read_json(
        spark, tmp_path, politics.LEGISLATOR,
        [{"id": {"bioguide": "B1"}, "name": {"first": "Jo", "last": "Do"},
          "terms": [{"party": "X", "state": "NY"}, {"party": "Y", "state": "CA"}]}],
    )
    assert rows(politics.legislators(people), "bioguide_id", "name", "party", "state") == [("B1", "Jo Do", "Y", "CA")]
    committees = read_json(
        spark, tmp_path, politics.COMMITTEE,
        [{"thomas_id": "SSFI", "name": "Finance", "subcommittees": [{"thomas_id": "01", "name": "Tax"}]}],
    )
    members = spark.createDataFrame(
        [(json.dumps({"SSFI": [{"bioguide": "B1", "title": "Chair"}], "SSFI01": [{"bioguide": "B1"}], "ZZ": [{"bioguide": "B2"}]}),)],
        "value string",
    )
    assert rows(politics.committee_assignments(members, committees), "bioguide_id", "committee_name", "role") == [
        ("B1", "Finance", "Chair"),
        ("B1", "Finance: Tax", "Member"),
        ("B2", "ZZ", "Member"),
    ]
    releases = read_json(
        spark, tmp_path, politics.PRESS_RELEASE,
        [{"member": {"bioguide_id": "B1", "name": "Jo"}, "date": "2024-01-02", "text": "t", "title": "h", "url": "u"}],
    )
    assert rows(politics.press_releases(releases), "bioguide_id", "date") == [("B1", dt.date(2024, 1, 2))]


def test_donations(spark, tmp_path):
    receipts = read_json(
        spark, tmp_path, politics.US_RECEIPT,
        [{"sub_id": "1", "committee_id": "C", "committee": {"name": "Com"}, "contributor_name": "D",
          "contribution_receipt_amount": 10.5, "contribution_receipt_date": "2024-03-04T00:00:00"}],
    )
    assert rows(politics.us_donations(receipts), "recipient_name", "amount", "donation_date") == [
        ("Com", 10.5, dt.date(2024, 3, 4))
    ]
    filed = read_json(spark, tmp_path, politics.US_COMMITTEE, [{"committee_id": "C", "name": "Com", "first_file_date": "2023-01-01"}])
    assert rows(politics.us_recipients(filed), "registered_date") == [(dt.date(2023, 1, 1),)]
    donations = csv(
        spark,
        "ECRef RegulatedEntityId RegulatedEntityName RegulatedEntityType DonorName DonorStatus "
        "CompanyRegistrationNumber Postcode Value ReceivedDate AcceptedDate",
        ("C1", "7", "Party", "PP", "Don", "Individual", "", "AB1", "£1,200.50", "", "05/02/2024"),
    )
    assert rows(politics.uk_donations(donations), "amount", "donation_date", "donor_company_number") == [
        (1200.5, dt.date(2024, 2, 5), None)
    ]
    registered = csv(spark, "ECRef RegulatedEntityName ApprovedDate", ("PP7931", "Party", "01/02/2003"))
    assert rows(politics.uk_recipients(registered), "recipient_id", "registered_date") == [("7931", dt.date(2003, 2, 1))]


def test_ocds(spark, tmp_path):
    release = {
        "id": "r1", "ocid": "o1", "date": "2024-01-05T00:00:00Z", "tag": ["tender"], "buyer": {"id": "b", "name": "Buyer"},
        "tender": {
            "procurementMethod": "open", "tenderPeriod": {"endDate": "2024-02-01T00:00:00Z"},
            "lots": [{"id": "1", "value": {"amount": 5.0, "currency": "GBP"}}, {"id": "2", "value": {"amountGross": 6.0}}],
            "items": [{"classification": {"scheme": "X", "id": "no"}, "additionalClassifications": [{"scheme": "CPV", "id": "45"}]}],
            "numberOfTenderers": 9,
        },
        "bids": {"statistics": [{"measure": "bids", "value": 1, "relatedLot": "2"}]},
        "awards": [
            {"id": "a", "relatedLots": ["2"], "suppliers": [{"id": "s1", "name": "S1"}, {"id": "s2", "name": "S2"}]},
            {"id": "b", "date": "2024-03-01", "value": {"amount": 3.0, "currency": "EUR"}},
        ],
        "contracts": [
            {"awardID": "a", "value": {"amount": 2.0, "currency": "GBP"}, "dateSigned": "2024-02-20"},
            {"awardID": "a", "value": {"amount": 4.0}},
        ],
    }
    change = {
        "id": "r2", "ocid": "o1", "tag": ["contractAmendment"],
        "contracts": [{"awardID": "a", "value": {"amount": 9.0, "currency": "GBP"}}],
    }
    releases = read_json(spark, tmp_path, procurement.RELEASE, [release, change])
    processes = procurement.ocds_processes(releases)
    assert rows(processes, "process_id", "category_code", "tender_value", "number_of_tenderers", "tender_published_date") == [
        ("o1/1", "45", 5.0, 9, dt.date(2024, 1, 5)),
        ("o1/2", "45", 6.0, 1, dt.date(2024, 1, 5)),
    ]
    awards = procurement.ocds_awards(releases)
    assert rows(awards, "award_id", "process_id", "supplier_id", "award_value", "award_date", "final_value") == [
        ("o1/a", "o1/2", "s1", 6.0, dt.date(2024, 2, 20), None),
        ("o1/a", "o1/2", "s2", 6.0, dt.date(2024, 2, 20), None),
        ("o1/a", None, None, None, None, 9.0),
        ("o1/b", "o1", None, 3.0, dt.date(2024, 3, 1), None),
    ]


def test_us_awards(spark, tmp_path):
    found = read_json(
        spark, tmp_path, procurement.US_AWARD,
        [{"generated_internal_id": "g1", "Awarding Sub Agency": "Sub"}, {"generated_internal_id": "g2", "Recipient Name": "R"}],
    )
    details = read_json(
        spark, tmp_path, procurement.US_AWARD_DETAIL,
        [{"generated_internal_id": "g1", "total_obligation": 4.0, "date_signed": "2024-01-01",
          "recipient": {"recipient_uei": "U", "recipient_name": "N"},
          "latest_transaction_contract_data": {"extent_competed": "NDO", "number_of_offers_received": "3"}}],
    )
    assert rows(procurement.us_processes(found, details), "process_id", "buyer_name", "procurement_method", "number_of_tenderers") == [
        ("g1", "Sub", "direct", 3),
        ("g2", None, None, None),
    ]
    assert rows(procurement.us_awards(found, details), "award_id", "supplier_name", "award_value") == [
        ("g1", "N", 4.0),
        ("g2", "R", None),
    ]


def test_uk_companies(spark, tmp_path):
    table = read_json(
        spark, tmp_path, companies.UK_COMPANY,
        [{"company_number": "01", "company_name": "C", "date_of_creation": "2020-01-01",
          "previous_company_names": [{"name": "B"}], "registered_office_address": {"premises": "1", "postal_code": "X"}}],
    )
    assert rows(companies.uk_companies(table), "company_id", "registered_address", "previous_name_count") == [("gb:01", "1, X", 1)]
    officers = read_json(
        spark, tmp_path, companies.UK_OFFICER,
        [{"company_number": "01", "name": "O", "links": {"officer": {"appointments": "/officers/abc/appointments"}}},
         {"company_number": "01", "name": "P", "links": {"officer": {"appointments": "/x/abc"}}}],
    )
    assert rows(companies.uk_officers(officers), "name", "officer_id") == [("O", "abc"), ("P", None)]
    controllers = read_json(
        spark, tmp_path, companies.UK_CONTROLLER,
        [{"company_number": "01", "kind": "super-secure-person", "description": "protected"},
         {"company_number": "01", "kind": "individual-person", "name": "Jo", "date_of_birth": {"year": 1970, "month": 3}},
         {"company_number": "01", "kind": "corporate-entity", "name": "Co", "natures_of_control": ["a", "b"],
          "identification": {"country_registered": "England", "registration_number": "12 34"}}],
    )
    assert rows(companies.uk_controllers(controllers), "controller_id", "controller_kind", "controller_company_id", "control_type") == [
        ("gb:psc:CO", "legal_entity", "gb:00001234", "a|b"),
        ("gb:psc:JO|1970-03", "individual", None, None),
        ("gb:statement:super-secure-person", "statement", None, "super-secure-person"),
    ]


def test_lei_and_norway(spark, tmp_path):
    entity = {"jurisdiction": "US-DE", "legalName": {"name": "L"}, "creationDate": "2001-02-03T00:00:00Z",
              "expiration": {"reason": "DISSOLVED", "date": "2010-01-01T00:00:00Z"},
              "legalAddress": {"addressLines": ["a", ""], "city": "W"}}
    records = read_json(spark, tmp_path, companies.LEI_RECORD, [{"attributes": {"lei": "X1", "entity": entity}}])
    assert rows(companies.lei_companies(records), "company_id", "jurisdiction", "dissolution_date", "registered_address") == [
        ("lei:X1", "US", dt.date(2010, 1, 1), "a, W")
    ]
    parent = {"attributes": {"lei": "P1", "entity": entity}}
    parents = read_json(
        spark, tmp_path, companies.LEI_PARENT,
        [{"lei": "X1", "level": "ultimate-parent", "data": parent}, {"lei": "X1", "level": "direct-parent", "data": parent},
         {"lei": "X2", "level": "direct-parent"}],
    )
    assert rows(companies.lei_controllers(parents), "company_id", "controller_id", "control_type") == [
        ("lei:X1", "lei:P1", "direct-parent")
    ]
    entities = read_json(
        spark, tmp_path, companies.NO_ENTITY,
        [{"organisasjonsnummer": "9", "navn": "N", "underAvvikling": True, "stiftelsesdato": "1999-01-01",
          "forretningsadresse": {"adresse": ["Gate 1"], "postnummer": "0001", "poststed": "Oslo"}}],
    )
    assert rows(companies.no_companies(entities), "status", "registered_address", "previous_name_count") == [
        ("in_liquidation", "Gate 1, 0001 Oslo", 0)
    ]
    roles = read_json(
        spark, tmp_path, companies.NO_ROLES,
        [{"organisasjonsnummer": "9", "rollegrupper": [{"roller": [
            {"type": {"kode": "LEDE"}, "person": {"fodselsdato": "1980-01-01", "navn": {"fornavn": "Kari", "etternavn": "Vik"}}},
            {"type": {"kode": "REVI"}, "enhet": {"organisasjonsnummer": "8", "navn": ["Rev", "AS"]}},
            {"type": {"kode": "MEDL"}, "avregistrert": True, "person": {"navn": {"fornavn": "Old"}}}]}]}],
    )
    assert rows(companies.no_officers(roles), "officer_id", "name", "role") == [
        ("no:8", "Rev AS", "REVI"),
        ("no:person:KARI VIK|1980-01-01", "Kari Vik", "LEDE"),
    ]


def test_court(spark, tmp_path):
    dockets = read_json(
        spark, tmp_path, court.DOCKET,
        [{"id": 5, "court_id": "nysd", "case_name": " A v B ", "date_filed": "2020-01-01",
          "assigned_to": "https://x.example/people/1124/", "absolute_url": "/docket/5/"}],
    )
    assert rows(court.court_cases(dockets), "case_id", "case_name", "assigned_judge_id", "url") == [
        ("5", "A v B", "1124", "https://www.courtlistener.com/docket/5/")
    ]
    parties = read_json(
        spark, tmp_path, court.PARTY,
        [{"docket_id": 5, "name": "A", "party_types": [{"name": "Plaintiff", "docket_id": 5}, {"name": "Plaintiff"}, {"name": "X", "docket_id": 6}]},
         {"docket_id": 5, "name": "B", "party_types": []}],
    )
    assert rows(court.case_parties(parties), "party_name", "party_role") == [("A", "Plaintiff"), ("B", None)]
    assert rows(court.case_counsel(read_json(spark, tmp_path, court.ATTORNEY, [{"docket_id": 5, "name": "Q"}])), "counsel_name") == [("Q",)]
    disclosures = read_json(
        spark, tmp_path, court.DISCLOSURE,
        [{"person": "https://x.example/people/1124/", "year": 2021, "filepath": "f",
          "investments": [{"description": "Acme", "gross_value_code": "K"}, {"description": " "}],
          "gifts": [{"source": "G", "description": "pen", "value": "$1,199.00"}],
          "reimbursements": [{"source": "U", "date_raw": "May", "location": "NY", "purpose": ""}],
          "debts": [{"creditor_name": "Bank", "value_code": "P4"}]}],
    )
    assert rows(court.judge_interests(disclosures), "interest_type", "counterparty", "description", "value_low", "value_high", "judge_id") == [
        ("debt", "Bank", None, 50000001.0, None, "1124"),
        ("gift", "G", "pen", 1199.0, 1199.0, "1124"),
        ("investment", "Acme", None, 15001.0, 50000.0, "1124"),
        ("reimbursement", "U", "May; NY", None, None, "1124"),
    ]


def test_european_parliament(spark, tmp_path):
    def membership(organization, start, end=None, kind=None, role=None, represents=None):
        return {"organization": organization, "membershipClassification": kind, "role": role,
                "memberDuring": {"startDate": start, "endDate": end}, "represents": represents}

    group = "def/ep-entities/EU_POLITICAL_GROUP"
    mandate = {"role": parliament.EP_MANDATE, "represents": ["x/country/FRA"]}
    people = read_json(
        spark, tmp_path, parliament.EP_PERSON,
        [
            {"identifier": "1", "label": "Ann", "hasMembership": [
                membership("org/ep-10", "2024-07-16", **mandate),
                membership("org/1", "2024-07-16", "2024-09-30", group), membership("org/2", "2024-10-01", None, group)]},
            {"identifier": "2", "label": "Ben", "hasMembership": [
                membership("org/ep-10", "2024-07-16", "2024-08-01", **mandate), membership("org/1", "2024-07-16", None, group)]},
            {"identifier": "3", "label": "Out", "hasMembership": [membership("org/ep-9", "2019-07-16", **mandate)]},
        ],
    )
    bodies = spark.createDataFrame([("1", "G1"), ("2", "G2")], "identifier string, label string")
    decisions = read_json(
        spark, tmp_path, parliament.EP_DECISION,
        [{"id": "eli/d1", "notation_votingId": "v1", "activity_date": "2024-10-09", "decision_method": parliament.EP_ROLL_CALL,
          "activity_label": {"fr": "T"}, "had_voter_favor": ["person/1", "person/9"]},
         {"id": "eli/d2", "notation_votingId": "v2", "activity_date": "2024-07-20", "decision_method": parliament.EP_ROLL_CALL,
          "had_voter_against": ["person/2"]},
         {"id": "eli/d3", "notation_votingId": "v3", "activity_date": "2024-07-20", "decision_method": "show of hands"}],
    )
    assert rows(parliament.ep_members(people, 10), "member_id", "country") == [("1", "FR"), ("2", "FR")]
    assert rows(parliament.ep_votings(decisions), "voting_id", "title", "vote_date") == [
        ("v1", "T", dt.date(2024, 10, 9)),
        ("v2", None, dt.date(2024, 7, 20)),
    ]
    assert rows(parliament.ep_affiliations(people, bodies, 10), "member_id", "org_name", "term") == [
        ("1", "G1", "10"),
        ("1", "G2", "10"),
        ("2", "G1", "10"),
    ]
    votes = parliament.ep_member_votes(decisions, people, bodies, 10)
    assert rows(votes, "voting_id", "member_id", "position", "group_at_vote") == [
        ("v1", "1", "for", "G2"),
        ("v1", "9", "for", None),
        ("v2", "1", "absent", "G1"),
        ("v2", "2", "against", "G1"),
    ]


def test_a_voting_and_member_are_one_row(spark, tmp_path):
    """Two labels of a group, lists that name a member twice and repeated decisions add no rows."""
    member = [{"organization": "org/ep-10", "role": parliament.EP_MANDATE, "memberDuring": {"startDate": "2024-07-16"}},
              {"organization": "org/1", "membershipClassification": "def/ep-entities/EU_POLITICAL_GROUP", "memberDuring": {"startDate": "2024-07-16"}}]
    people = read_json(spark, tmp_path, parliament.EP_PERSON, [{"identifier": i, "label": i, "hasMembership": member} for i in "12"])
    bodies = spark.createDataFrame([("1", "G1"), ("1", "G0")], "identifier string, label string")
    roll = {"id": "eli/d1", "notation_votingId": "v1", "activity_date": "2024-10-09", "decision_method": parliament.EP_ROLL_CALL,
            "had_voter_favor": ["person/1"], "had_voter_abstention": ["person/1"]}
    decisions = read_json(spark, tmp_path, parliament.EP_DECISION, [roll, roll])
    votes = parliament.ep_member_votes(decisions, people, bodies, 10)
    assert sorted(rows(votes, "voting_id", "member_id", "position", "group_at_vote")) == [("v1", "1", "abstain", "G0"), ("v1", "2", "absent", "G0")]


def test_swiss_parliament(spark):
    groups = spark.createDataFrame([("g", None, "Conseil")], "id string, name_de string, name_fr string")
    votings = spark.createDataFrame(
        [(str(i), f"2024-01-0{i}T08:00", "g", "Titel") for i in range(1, 5)],
        "id string, date string, group_id string, title_de string",
    ).selectExpr("*", "'a' AS affair_id")
    contract = parliament.ch_votings(votings, groups, "CHE")
    assert rows(contract, "voting_id", "chamber", "vote_date")[0] == ("1", "Conseil", dt.date(2024, 1, 1))
    votes = spark.createDataFrame(
        [("1", "m", "YES", "A"), ("2", "m", "no", "A"), ("3", "m", "absent_excused", "B"), ("4", "m", "odd", "B"), ("9", "m", "yes", "A")],
        "voting_id string, person_id string, vote string, person_parliamentary_group_name_de string",
    )
    cast = parliament.ch_member_votes(votes, contract, "CHE")
    assert rows(cast, "voting_id", "position") == [("1", "for"), ("2", "against"), ("3", "absent"), ("4", "odd")]
    assert rows(parliament.ch_affiliations(cast, contract), "org_name", "start_date", "end_date") == [
        ("A", dt.date(2024, 1, 1), dt.date(2024, 1, 2)),
        ("B", dt.date(2024, 1, 3), None),
    ]
    persons = spark.createDataFrame([("m", "", "Al", "Bo")], "id string, fullname string, firstname string, lastname string")
    assert rows(parliament.ch_members(persons, "CHE"), "member_id", "name") == [("m", "Al Bo")]
    interests = spark.createDataFrame(
        [("i", "m", "Org", "Honorary", None)],
        "id string, person_id string, name_de string, type_payment_harmonized string, end_date string",
    )
    assert rows(parliament.ch_interests(interests, "CHE"), "organisation", "paid") == [("Org", "unpaid")]


def test_cube(spark, tmp_path):
    cube = {
        "dataset_code": "d", "class": "dataset", "label": "D", "id": ["geo", "unit", "time"], "size": [2, 1, 2],
        "value": {"0": 1.5, "3": 4.0}, "status": {"2": "e"},
        "dimension": {
            "geo": {"category": {"index": {"AT": 0, "BE": 1}, "label": {"AT": "Austria"}}},
            "unit": {"category": {"index": ["EUR"], "label": {}}},
            "time": {"category": {"index": {"2020": 0, "2021": 1}}},
        },
        "extension": {"status": {"label": {"e": "estimated"}}},
    }
    table = read_json(spark, tmp_path, "dataset_code string, " + statistics.CUBE, [cube])
    observations = statistics.cube_observations(table)
    assert rows(observations, "position", "time_period", "unit", "value", "status_label") == [
        (0, "2020", "EUR", 1.5, None),
        (2, "2020", "EUR", None, "estimated"),
        (3, "2021", "EUR", 4.0, None),
    ]
    first = {row.position: row for row in observations.collect()}
    assert first[0].dimension_labels["geo"] == "Austria" and first[3].dimensions["geo"] == "BE"
