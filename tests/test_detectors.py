"""Every detector on a small fixture with rows that must and must not be reported."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures import d, rows, table
from leadspark.functions import relational
from leadspark.functions.checks import ParameterError
from leadspark.operators import campaign_finance, companies, court, lobbying, parliamentary, procurement, statistical
from leadspark.plans.registry import RELEASED


# ------------------------------------------------------------------ any table


def test_zscore_is_leave_one_out(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 11.0), (3, 9.0), (4, 500.0), (5, None)], "id long, amount double")
    assert rows(statistical.zscore_outliers(df), "candidate_id", "observation_count") == [("row-4", 1)]
    same = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "id long, amount double")
    assert statistical.zscore_outliers(same).count() == 0


def test_zscore_with_two_values_uses_the_global_score(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 10.0)], "id long, amount double")
    assert rows(statistical.zscore_outliers(df, z_threshold=1.0), "candidate_id", "z_score") == [
        ("row-1", 1.0),
        ("row-2", 1.0),
    ]


def test_level_shift(spark):
    days = [10.0, 11.0, 10.0, 50.0, 51.0]
    df = spark.createDataFrame(
        [(i + 1, dt.date(2024, 1, i + 1), a) for i, a in enumerate(days)], "id long, observed_at date, amount double"
    )
    for partitions in (1, 2, 5):
        found = statistical.level_shift(df, partitions=partitions).orderBy("observed_at")
        assert rows(found, "candidate_id", "previous_amount") == [("row-4", 10.0), ("row-5", 50.0)]


def test_coverage_gaps(spark):
    df = spark.createDataFrame(
        [(1, d("2024-01-01")), (2, d("2024-01-02")), (3, d("2024-01-10")), (4, None)], "id long, observed_at date"
    )
    assert rows(statistical.coverage_gaps(df), "candidate_id", "gap_days") == [("gap-2024-01-02", 8)]
    assert statistical.coverage_gaps(df, maximum_gap_days=8).count() == 0


def test_rare_levels(spark):
    df = spark.createDataFrame([("a",)] * 20 + [("b",), (None,)], "group string")
    assert rows(statistical.rare_levels(df), "level_value", "level_count", "observation_count") == [("b", 1, 21)]
    few = spark.createDataFrame([("a",)] * 3 + [("b",)], "group string")
    assert statistical.rare_levels(few).count() == 0


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (None, "z"), (None, "z")], "id long, v string")
    assert rows(statistical.duplicate_rows(df), "candidate_id", "duplicate_count") == [("row-1", 2), ("row-null", 2)]
    assert rows(statistical.duplicate_rows(df, columns=["id"]), "candidate_id", "duplicate_count") == [
        ("row-1", 3),
        ("row-null", 2),
    ]


def test_missingness_clusters(spark):
    df = spark.createDataFrame(
        [("a", None), ("a", None), ("b", 1.0), (None, None), ("c", None)], "group string, amount double"
    )
    found = statistical.missingness_clusters(df, min_missing_fraction=0.4)
    assert rows(found, "cluster_value", "missing_fraction") == [("a", 0.4)]


# ------------------------------------------------------------------ campaign finance


def gift(n, donor, day, amount=3500.0, recipient="R", employer=None, postcode=None):
    return {
        "donation_id": str(n), "recipient_id": recipient, "recipient_name": "Rec", "donor_name": donor,
        "donor_employer": employer, "donor_postcode": postcode, "amount": amount, "donation_date": day,
    }


def test_maxed_donor_clusters(spark):
    donations = table(
        spark,
        "donations",
        [
            gift(1, "Ann", "2024-01-01", employer=" acme "),
            gift(2, "Bob", "2024-01-04", employer="ACME", amount=3150.0),
            gift(3, "Cy", "2024-01-08", employer="Acme"),
            gift(4, "Cy", "2024-01-08", employer="Acme"),
            gift(5, "Dee", "2024-01-09", employer="Acme", amount=3149.0),
            gift(6, "Eve", "2024-01-01", employer="Retired", postcode="ab1 2c"),
            gift(7, "Flo", "2024-01-02", employer="Retired", postcode="AB12C"),
            gift(8, "Guy", "2024-01-09", employer="Retired", postcode="AB12C"),
        ],
    )
    found = campaign_finance.maxed_donor_clusters(donations)
    assert rows(found, "candidate_id", "window_start", "window_end", "donors", "donations", "total_amount", "donor_names") == [
        ("R|employer|ACME", d("2024-01-01"), d("2024-01-08"), 3, 4, 13650.0, "Ann | Bob | Cy")
    ]
    wider = campaign_finance.maxed_donor_clusters(donations, window_days=8)
    assert {row[0] for row in rows(wider, "candidate_id")} == {"R|employer|ACME", "R|postcode|AB12C"}


def test_new_recipient_single_funder(spark):
    recipients = table(
        spark,
        "recipients",
        [
            {"recipient_id": "R", "name": "New", "registered_date": "2024-01-01"},
            {"recipient_id": "Q", "name": "Mixed", "registered_date": "2024-01-01"},
            {"recipient_id": "N", "name": "Undated"},
        ],
    )
    donations = table(
        spark,
        "donations",
        [
            gift(1, "Ann", "2023-12-01", 9000.0),
            gift(2, " ann", "2024-03-31", 9000.0),
            gift(3, "Bob", "2024-02-01", 1000.0),
            gift(4, "Bob", "2024-04-01", 99000.0),
            gift(5, "Ann", "2024-02-01", 8900.0, "Q"),
            gift(6, "Bob", "2024-02-01", 1100.0, "Q"),
            gift(7, "Ann", "2024-02-01", 50000.0, "N"),
        ],
    )
    found = campaign_finance.new_recipient_single_funder(donations, recipients)
    assert rows(found, "recipient_id", "donors", "donations", "total_amount", "top_donor", "top_share") == [
        ("R", 2, 3, 19000.0, " ann", 0.9474)
    ]


def test_structured_gifts(spark):
    donations = table(
        spark,
        "donations",
        [
            gift(1, "Ann", "2024-01-01", 4000.0, postcode="x 1"),
            gift(2, "Ann", "2024-01-15", 4000.0, postcode="X1"),
            gift(3, "Ann", "2024-01-31", 3180.0, postcode="X1"),
            gift(4, "Ann", "2024-01-20", 11180.0, postcode="X1"),
            gift(5, "Bob", "2024-01-01", 4000.0),
            gift(6, "Bob", "2024-01-02", 4000.0),
            gift(7, "Bob", "2024-02-02", 4000.0),
        ],
    )
    found = campaign_finance.structured_gifts(donations)
    assert rows(found, "candidate_id", "gifts", "total_amount", "largest_gift", "window_end") == [
        ("R|ANN|X1", 3, 11180.0, 4000.0, d("2024-01-31"))
    ]


# ------------------------------------------------------------------ companies


def control(child, parent, ceased=None, **extra):
    return {
        "company_id": child, "controller_id": f"c-{parent}", "controller_name": parent,
        "controller_kind": "legal_entity", "controller_company_id": parent, "ceased_on": ceased, **extra,
    }


def test_circular_control(spark):
    edges = [
        ("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"),
        ("s", "s"), ("s", "a"),
        ("x", "a"),
        ("p", "q"), ("q", "r"), ("r", "t"), ("t", "p"),
    ]
    controllers = table(
        spark, "company_controllers", [control(*edge) for edge in edges] + [control("m", "n"), control("n", "m", "2020-01-01")]
    )
    found = companies.circular_control(controllers, limit=100)
    assert rows(found, "company_id", "cycle_length", "cycle_path") == [
        ("s", 1, "s > s"),
        ("a", 2, "a > b > a"),
        ("b", 2, "b > a > b"),
        ("c", 3, "c > a > b > c"),
        ("p", 4, "p > q > r > t > p"),
        ("q", 4, "q > r > t > p > q"),
        ("r", 4, "r > t > p > q > r"),
        ("t", 4, "t > p > q > r > t"),
    ]
    assert companies.circular_control(controllers, max_depth=3).filter("cycle_length > 3").count() == 0
    assert rows(companies.circular_control(controllers, max_depth=1), "company_id") == [("s",)]


def company(id, **extra):
    return {"company_id": id, "jurisdiction": "gb", "name": f"Company {id}", **extra}


def test_frequent_name_changes(spark):
    found = companies.frequent_name_changes(
        table(spark, "companies", [company("a", previous_name_count=6), company("a", previous_name_count=9), company("b", previous_name_count=5)])
    )
    assert rows(found, "company_id", "previous_name_count") == [("a", 9)]


def test_prolific_officer(spark):
    officers = [
        {"company_id": str(i), "officer_id": "o", "name": "Off", "company_name": f"N{i:03}", "role": "dir"} for i in range(7)
    ]
    officers += [{"company_id": "z1", "officer_id": "r", "name": "Rev", "role": " revi "}] * 9
    officers += [{"company_id": str(i), "officer_id": "q", "name": "Gone", "resigned_on": "2020-01-01"} for i in range(9)]
    controllers = [
        {"company_id": str(i), "controller_id": "k", "controller_name": "Con", "controller_kind": "individual"} for i in range(6)
    ]
    controllers += [
        {"company_id": str(i), "controller_id": "st", "controller_name": "S", "controller_kind": "statement"} for i in range(9)
    ]
    found = companies.prolific_officer(
        table(spark, "company_officers", officers), table(spark, "company_controllers", controllers), min_companies=6, limit=100
    )
    assert rows(found, "candidate_id", "companies", "example_companies") == [
        ("officer|o", 7, "N000|N001|N002|N003|N004"),
        ("controller|k", 6, "0|1|2|3|4"),
    ]


def test_rapid_dissolution(spark):
    found = companies.rapid_dissolution(
        table(
            spark,
            "companies",
            [
                company("same", incorporation_date="2020-01-01", dissolution_date="2020-01-01"),
                company("year", incorporation_date="2021-01-01", dissolution_date="2022-01-01"),
                company("over", incorporation_date="2021-01-01", dissolution_date="2022-01-02"),
                company("back", incorporation_date="2021-01-01", dissolution_date="2020-01-01"),
            ],
        )
    )
    assert rows(found, "company_id", "days_existed") == [("same", 0), ("year", 365)]


def test_secrecy_jurisdiction_controller(spark):
    home = table(spark, "companies", [company("gb:1"), company("us:2", jurisdiction="US")])
    held = table(
        spark,
        "company_controllers",
        [
            control("gb:1", "p", controller_country=" pa", control_type="b"),
            control("gb:1", "p", controller_country="PA", control_type="a"),
            control("us:2", "p", controller_country="US"),
            control("us:9", "p", controller_country="US"),
            control("lei:3", "p", controller_country="US"),
            control("gb:1", "q", controller_country="FR"),
            control("gb:1", "r", "2020-01-01", controller_country="PA"),
        ],
    )
    found = companies.secrecy_jurisdiction_controller(held, home)
    assert rows(found, "candidate_id", "controller_country", "company_jurisdiction", "control_type") == [
        ("gb:1|c-p", "PA", "GB", "a"),
        ("lei:3|c-p", "US", None, None),
    ]


def test_shared_registered_address(spark):
    near = [company(str(i), registered_address="1 Élan St." if i % 2 else "1, élan-ST") for i in range(5)]
    near.append(company("9", registered_address="1 élan st", dissolution_date="2020-01-01", jurisdiction=None, name=None))
    far = [company(f"f{i}", registered_address="2 Elan St") for i in range(4)]
    found = companies.shared_registered_address(table(spark, "companies", near + far), min_companies=5)
    assert rows(found, "candidate_id", "companies", "current_companies", "jurisdictions", "example_companies") == [
        ("1élanst", 6, 5, "GB", "Company 0|Company 1|Company 2|Company 3|Company 4")
    ]


# ------------------------------------------------------------------ court


def case(id, filed, judge="J", **extra):
    return {
        "case_id": id, "court_id": "ct", "case_name": f"Case {id}", "date_filed": filed, "assigned_judge_id": judge,
        "assigned_judge_name": f"Judge {judge}", **extra,
    }


def interest(kind, name, year, judge="J", **extra):
    return {"judge_id": judge, "interest_type": kind, "counterparty": name, "report_year": year, **extra}


def test_gift_from_litigant_or_counsel(spark):
    cases = table(spark, "court_cases", [case("1", "2020-05-05", date_terminated="2021-01-01"), case("2", "2020-05-05", "K")])
    parties = table(spark, "case_parties", [{"case_id": "1", "party_name": "The Acme Corp. (NY)"}, {"case_id": "2", "party_name": "Acme"}])
    counsel = table(spark, "case_counsel", [{"case_id": "1", "counsel_name": "Jo Doe", "firm_name": "Big Firm LLP"}])
    interests = table(
        spark,
        "judge_interests",
        [
            interest("Gift", "ACME Foundation", 2018),
            interest("gift", "Acme", 2017),
            interest("reimbursement", "Big Firm", 2023),
            interest("gift", "Jo", 2020),
            interest("investment", "Jo Doe", 2020),
            interest("gift", "Big", 2020),
            interest("gift", "Acmex", 2020),
        ],
    )
    found = court.gift_from_litigant_or_counsel(cases, parties, counsel, interests, limit=100)
    assert rows(found, "case_id", "matched_as", "benefit_source", "match_type", "report_year") == [
        ("1", "firm", "Big Firm", "exact", 2023),
        ("1", "party", "ACME Foundation", "prefix", 2018),
    ]


def test_all_gifts_of_a_case_follow_each_other(spark):
    ids = [str(n) for n in range(12)]
    cases = table(spark, "court_cases", [case(id, "2020-05-05") for id in ids])
    parties = table(spark, "case_parties", [{"case_id": id, "party_name": "Acme Inc"} for id in ids])
    counsel = table(spark, "case_counsel", [{"case_id": "none", "counsel_name": "Jo Doe"}])
    interests = table(spark, "judge_interests", [interest("gift", "Acme", 2020, value_low=n) for n in range(40)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = court.gift_from_litigant_or_counsel(cases, parties, counsel, interests).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(row.case_id, row.value_low) for row in found} == {(id, float(n)) for id in ids for n in range(40)}
    # Cases are read once, one after the other; what waits in memory are the interests of a name.
    assert len(found) == 12 * 40
    assert sum(one.case_id != other.case_id for one, other in zip(found, found[1:])) == 11


def test_leads_of_one_name_are_dealt_over_tasks(spark):
    ids = [str(n) for n in range(600)]
    cases = table(spark, "court_cases", [case(id, "2020-05-05") for id in ids])
    parties = table(spark, "case_parties", [{"case_id": id, "party_name": "Acme Inc"} for id in ids])
    counsel = table(spark, "case_counsel", [{"case_id": "none", "counsel_name": "Jo Doe"}])
    interests = table(spark, "judge_interests", [interest("gift", "Acme", 2020, value_low=n) for n in range(40)])
    holdings = table(spark, "judge_interests", [interest("investment", "Acme", 2020)])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    for found, expected in (
        (court.gift_from_litigant_or_counsel(cases, parties, counsel, interests), 600 * 40),
        (court.judge_holds_party_stock(cases, parties, holdings), 600),
    ):
        dealt = [row["count"] for row in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(dealt) == expected
        assert max(dealt) < 2 * expected / tasks


@pytest.mark.parametrize("few", [0, 100_000])
def test_keys_with_few_pairs_are_dealt_over_tasks_too(spark, monkeypatch, few):
    monkeypatch.setattr(relational, "_FEW_KEYS", few)
    left = spark.range(1500).selectExpr("id % 750 AS key", "id AS by")
    right = spark.range(500).selectExpr("id AS key", "id AS value")
    pairs = spark.range(500).selectExpr("id AS key", "2.0D AS pairs")
    found = relational.dealt_join(left, right, ["key"], "by", pairs)
    joined = {tuple(row) for row in found.select("key", "by", "value").collect()}
    assert joined == {(n % 750, n, n % 750) for n in range(1500) if n % 750 < 500}
    dealt = [row["count"] for row in found.groupBy(F.spark_partition_id()).count().collect()]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    assert sum(dealt) == 1000
    assert max(dealt) < 2 * 1000 / tasks


def test_all_gifts_of_long_lists_are_leads(spark):
    cases = table(spark, "court_cases", [case("1", "2020-05-05"), case("2", "2015-05-05", date_terminated="2016-01-01")])
    parties = table(spark, "case_parties", [{"case_id": id, "party_name": "Acme Inc"} for id in "12"])
    counsel = table(spark, "case_counsel", [{"case_id": "none", "counsel_name": "Jo Doe"}])
    # Values that round to the same are different gifts.
    gifts = [interest("gift", name, 2018 + n % 2, value_low=1 + n / 1e7) for name in ("Acme", "Acme Fund") for n in range(3000)]
    found = court.gift_from_litigant_or_counsel(
        cases, parties, counsel, table(spark, "judge_interests", gifts), amounts=lambda value: F.round(value, 2)
    )
    counted = found.groupBy("case_id", "match_type", "report_year", "value_low").count().collect()
    counts = {tuple(row)[:4]: row["count"] for row in counted}
    assert counts == {
        ("1", "exact", 2018, 1.0): 1500, ("1", "exact", 2019, 1.0): 1500, ("1", "prefix", 2018, 1.0): 1500,
        ("1", "prefix", 2019, 1.0): 1500, ("2", "exact", 2018, 1.0): 1500, ("2", "prefix", 2018, 1.0): 1500,
    }


def test_judge_holds_party_stock(spark):
    cases = table(spark, "court_cases", [case("1", "2020-05-05"), case("1", "2020-06-05")])
    parties = table(spark, "case_parties", [{"case_id": "1", "party_name": "Acme Widgets Inc", "party_role": "Defendant"}])
    interests = table(
        spark,
        "judge_interests",
        [
            interest("Investment", "Acme Widgets common stock", 2019, value_low=1, value_high=10),
            interest("Investment", "Acme Widgets common stock", 2024, value_low=5, value_high=50),
            interest("Investment", "ACME", 2020),
            interest("Investment", "Acme Widgets", 2018),
            interest("Investment", "Acm", 2020),
        ],
    )
    found = court.judge_holds_party_stock(cases, parties, interests, limit=100)
    columns = ["holding", "match_type", "first_report_year", "last_report_year", "max_value_low", "date_filed"]
    assert rows(found, *columns) == [
        ("Acme Widgets common stock", "exact", 2019, 2024, 5.0, d("2020-05-05")),
        ("ACME", "prefix", 2020, 2020, None, d("2020-05-05")),
    ]


def test_stock_matches_are_not_grouped_again(spark):
    cases = table(spark, "court_cases", [case("1", "2020-05-05")])
    parties = table(spark, "case_parties", [{"case_id": "1", "party_name": "Acme Inc", "party_role": role} for role in (None, "Defendant")])
    years = [(2018, 9), (2019, 1), (2020, None), (2021, 3)]
    interests = table(spark, "judge_interests", [interest("investment", "Acme", year, value_low=low) for year, low in years])
    found = court.judge_holds_party_stock(cases, parties, interests)
    # The years of a holding meet a case as one row: no aggregate lies above the joins.
    assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    got = {tuple(row) for row in rows(found, "party_role", "first_report_year", "last_report_year", "max_value_low")}
    assert got == {(None, 2019, 2021, 3.0), ("Defendant", 2019, 2021, 3.0)}


def test_long_pending_cases(spark):
    cases = table(
        spark,
        "court_cases",
        [
            case("old", "2015-01-01", nature_of_suit="Tort"),
            case("old2", "2016-01-01", nature_of_suit="Tort"),
            case("criminal", "2015-01-01"),
            case("ended", "2015-01-01", nature_of_suit="Tort", date_terminated="2020-01-01"),
            case("new", "2019-12-31", nature_of_suit="Tort"),
        ],
    )
    found = court.long_pending_cases(cases)
    assert rows(found, "case_id", "as_of_date", "years_pending", "judge_long_pending") == [
        ("old", d("2020-01-01"), 5.0, 2),
        ("old2", d("2020-01-01"), 4.0, 2),
    ]
    assert rows(court.long_pending_cases(cases, limit=1), "judge_long_pending") == [(2,)]
    earlier = court.long_pending_cases(cases, as_of_date="2019-06-01", civil_only=0)
    assert {row[0] for row in rows(earlier, "case_id")} == {"old", "old2", "criminal", "ended"}


def test_repeat_party_before_judge(spark):
    cases = table(spark, "court_cases", [case(str(i), "2020-01-01", "J" if i < 4 else "K") for i in range(5)])
    parties = [{"case_id": str(i), "party_name": "Acme Inc", "party_role": None if i == 0 else "Plaintiff"} for i in range(4)]
    parties += [{"case_id": "4", "party_name": "Acme", "party_role": "plaintiff"}]
    parties += [{"case_id": str(i), "party_name": "United States of America", "party_role": "plaintiff"} for i in range(4)]
    parties += [{"case_id": str(i), "party_name": "Foe", "party_role": "defendant"} for i in range(4)]
    found = court.repeat_party_before_judge(cases, table(spark, "case_parties", parties))
    columns = ["party_name", "judge_id", "cases_before_judge", "party_cases", "judge_share", "judges_in_court"]
    assert rows(found, *columns) == [("Acme Inc", "J", 4, 5, 0.8, 2)]


def test_single_judge_concentration(spark):
    cases = [case(f"a{i}", "2020-01-01", "J" if i else "K", division="N", nature_of_suit="Patent") for i in range(10)]
    cases += [case(f"b{i}", "2020-01-01", "J") for i in range(9)]
    found = court.single_judge_concentration(table(spark, "court_cases", cases))
    assert rows(found, "division", "nature_of_suit", "judge_id", "judge_cases", "judge_share", "judges_in_market") == [
        ("N", "Patent", "J", 9, 0.9, 2)
    ]


# ------------------------------------------------------------------ lobbying


def filing(id, period="2024-01-01", registrant="L", spend=None, **extra):
    return {
        "registration_id": id, "register": "reg", "period_start": period, "registrant_id": registrant,
        "registrant_name": f"Name {registrant}", "spend_low": spend, "spend_high": spend, **extra,
    }


def test_spending_spikes(spark):
    filings = [filing(f"f{q}", f"2023-{1 + 3 * q:02}-01", spend=[100_000, 110_000, 105_000, 102_000][q], client_id="c") for q in range(4)]
    filings += [filing("g", "2024-01-01", spend=900_000, client_id="c"), filing("g2", "2024-01-01", spend=800_000, client_id="c")]
    found = lobbying.spending_spikes(table(spark, "lobbying_registrations", filings))
    assert rows(found, "period_start", "total_spend", "prior_n") == [(d("2024-01-01"), 900_000.0, 4)]
    one_sided = [filing(f"h{q}", f"2023-{1 + 3 * q:02}-01", client_id="c", spend_high=None) | {"spend_low": 60_000 + q} for q in range(4)]
    assert rows(lobbying.spending_spikes(table(spark, "lobbying_registrations", one_sided), min_z_abs=1), "total_spend") == [(60_003.0,)]


def test_missing_spend_filings(spark):
    filings = [filing(f"f{i}", f"2024-0{i}-01", filing_type="Q", client_id="c") for i in range(1, 5)]
    filings += [filing("m", spend=5, registrant="M", filing_type="Q")]
    filings += [filing(f"n{i}", f"2024-0{i}-01", registrant="N", filing_type="RR") for i in range(1, 6)]
    found = lobbying.missing_spend_filings(table(spark, "lobbying_registrations", filings))
    assert rows(found, "registrant_id", "reports_without_spend", "distinct_clients") == [("L", 4, 1)]


def test_revolving_door_candidates(spark):
    people = table(
        spark,
        "lobbyists",
        [
            {"registration_id": "1", "lobbyist_id": "y", "name": "Yan", "former_public_office": "Clerk"},
            {"registration_id": "2", "lobbyist_id": "y", "name": "Yan", "former_public_office": " N/A "},
            {"registration_id": "1", "lobbyist_id": "z", "name": "Zed", "former_public_office": "not applicable"},
            {"registration_id": "9", "lobbyist_id": "w", "name": "Wim", "former_public_office": "Aide"},
        ],
    )
    filings = table(spark, "lobbying_registrations", [filing("1", client_name="B"), filing("2")])
    found = lobbying.revolving_door_candidates(people, filings)
    assert rows(found, "lobbyist_id", "registrations_with_lobbyist", "lobbied_for") == [("w", 1, None), ("y", 1, "B | Name L")]


def test_foreign_filings(spark):
    entities = table(
        spark, "lobbying_foreign_entities", [{"registration_id": "1", "foreign_entity_name": "E"}, {"registration_id": "x", "foreign_entity_name": "E"}]
    )
    found = lobbying.foreign_filings(table(spark, "lobbying_registrations", [filing("1", spend=4), filing("2")]), entities)
    assert rows(found, "registration_id", "foreign_entity_name", "spend") == [("1", "E", 4.0)]


def test_single_client_juggernauts(spark):
    filings = [filing("1", spend=200_000, client_id="a", client_name="A"), filing("2", "2024-04-01", spend=100_000, client_id="b", client_name="B")]
    filings += [filing("1b", spend=150_000, client_id="a", client_name="A")]
    filings += [filing(f"m{i}", spend=200_000, registrant="M", client_id=str(i)) for i in range(3)]
    found = lobbying.single_client_juggernauts(table(spark, "lobbying_registrations", filings))
    assert rows(found, "registrant_id", "distinct_clients", "registrations", "total_spend", "clients") == [("L", 2, 3, 300_000.0, "A | B")]


def test_pac_contribution_flow(spark):
    items = table(
        spark,
        "political_contributions",
        [
            {"registration_id": "1", "payee_name": "P", "honoree_name": "H", "amount": 5, "contributor_name": "c"},
            {"registration_id": "2", "payee_name": "P", "honoree_name": "H", "contributor_name": "c"},
            {"registration_id": "3", "amount": 9},
        ],
    )
    columns = ["payee_name", "n_contributions", "total_amount", "distinct_reports", "distinct_contributors"]
    assert rows(lobbying.pac_contribution_flow(items), *columns) == [("P", 2, 5.0, 2, 1)]


def test_issue_concentration_shifts(spark):
    filings = [filing("1", "2024-01-15", spend=100, issue_area="TAX| DEF "), filing("2", "2024-05-01", spend=150, issue_area="TAX|")]
    filings += [filing("3", "2024-05-01", registrant="M", spend=110, issue_area="DEF")]
    filings += [filing("4", "2024-01-01", issue_area="ENV"), filing("5", "2024-04-01", issue_area="ENV"), filing("6", "2024-04-01", registrant="M", issue_area="ENV")]
    found = lobbying.issue_concentration_shifts(table(spark, "lobbying_registrations", filings), limit=100)
    assert rows(found, "issue_area", "quarter", "spend_delta_pct", "registrants_delta_pct") == [
        ("TAX", d("2024-04-01"), 50.0, 0.0),
        ("ENV", d("2024-04-01"), None, 100.0),
    ]


def test_new_registrant_surge(spark):
    filings = [filing("1", "2023-01-01"), filing("2", "2024-06-30"), filing("3", "2024-01-01", "M", 7, client_id="c", client_name="C"), filing("4", "2023-12-30", "N")]
    found = lobbying.new_registrant_surge(table(spark, "lobbying_registrations", filings))
    assert rows(found, "registrant_id", "total_spend", "clients") == [("M", 7.0, "C"), ("N", None, None)][:1]


def test_shell_pattern_filings(spark):
    filings = [
        filing("1", client_description="Sovereign body", posted_by_name="a/b/c"),
        filing("2", client_description="sovereign"),
        filing("3", client_name="Global Public Benefit Inc"),
        filing("4"),
    ]
    acts = [
        {"registration_id": "3", "description": "ends with Annuit", "activity_index": 0},
        {"registration_id": "3", "description": "Coeptis starts", "activity_index": 1},
        {"registration_id": "4", "description": "Coeptis", "activity_index": 0},
        {"registration_id": "4", "description": "annuit", "activity_index": 1},
    ]
    people = [{"registration_id": "4", "lobbyist_id": "y", "former_public_office": "Head of State"}]
    found = lobbying.shell_pattern_filings(
        table(spark, "lobbyists", people), table(spark, "lobbying_registrations", filings), table(spark, "lobbying_activities", acts)
    )
    assert rows(found, "registration_id", "shell_score", "sig_esoteric_terms") == [("1", 2, 0), ("3", 2, 1)]


def test_fara_gap_narrowed(spark):
    filings = [
        filing("1", client_country="France") | {"registrant_name": "Hill & Knowlton, Inc."},
        filing("2", client_country="France"),
        filing("3", "2023-12-31", client_country="France"),
        filing("4", client_country="US"),
        filing("5", client_country="US"),
    ]
    entities = [{"registration_id": str(i), "foreign_entity_name": "E", "country": c} for i in range(1, 6) for c in ("B", "A", None)]
    acts = [
        {"registration_id": "5", "description": "met a foreign", "activity_index": 0},
        {"registration_id": "5", "description": "government", "activity_index": 5},
        {"registration_id": "4", "description": "foreign", "activity_index": 0},
        {"registration_id": "4", "description": "x", "activity_index": 1},
        {"registration_id": "4", "description": "government", "activity_index": 2},
    ]
    found = lobbying.fara_gap_narrowed(
        table(spark, "lobbying_registrations", filings),
        table(spark, "lobbying_foreign_entities", entities),
        table(spark, "lobbying_activities", acts),
        table(spark, "foreign_agent_registrants", [{"registrant_name": "HILL AND KNOWLTON INC"}]),
    )
    assert rows(found, "registration_id", "fe_countries", "sig_non_us_client", "sig_foreign_gov_topic") == [
        ("2", "A,B", 1, 0),
        ("5", "A,B", 0, 1),
    ]


def test_revolving_door_committee_match(spark):
    people = [
        {"registration_id": "1", "lobbyist_id": "y", "name": "Yan", "former_public_office": "Senate Finance Committee"},
        {"registration_id": "1", "lobbyist_id": "z", "name": "Zed", "former_public_office": "Veterans Affairs staff"},
    ]
    acts = [{"registration_id": "1", "general_issue_code": code, "description": code} for code in ("TAX", "DEF")]
    filings = [filing("1", spend=5, filing_type="Q1"), filing("2", spend=5, filing_type="Q1")]
    found = lobbying.revolving_door_committee_match(
        table(spark, "lobbyists", people), table(spark, "lobbying_registrations", filings), table(spark, "lobbying_activities", acts)
    )
    assert rows(found, "lobbyist_id", "former_committee", "general_issue_code") == [("y", "finance", "TAX")]
    unpaid = [filing("1", spend=0, filing_type="Q1")]
    found = lobbying.revolving_door_committee_match(
        table(spark, "lobbyists", people), table(spark, "lobbying_registrations", unpaid), table(spark, "lobbying_activities", acts)
    )
    assert found.count() == 0


def test_committee_match_meets_texts_last(spark):
    person = {"registration_id": "1", "lobbyist_id": "y", "name": "Yan", "former_public_office": "Senate Finance Committee"}
    acts = [{"registration_id": "1", "general_issue_code": "TAX", "description": text} for text in ("a", "a", None)]
    filings = [filing("1", spend=5, filing_type="Q1"), filing("1", spend=5, filing_type="Q1")]
    found = lobbying.revolving_door_committee_match(
        table(spark, "lobbyists", [person, person]), table(spark, "lobbying_registrations", filings), table(spark, "lobbying_activities", acts)
    )
    # Every repeated row counts, and activities are unfolded above the joins, for leads only.
    assert sorted(rows(found, "description"), key=str) == [("a",)] * 8 + [(None,)] * 4
    assert "Generate explode" in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_committee_say_vs_pay(spark):
    people = [{"registration_id": "1", "lobbyist_id": "y", "name": "Yan", "former_public_office": "Finance aide"}]
    seats = [{"bioguide_id": "A", "committee_name": "Finance", "role": "Chair"}, {"bioguide_id": "B", "committee_name": "Rules", "role": "Member"}]
    members = [{"bioguide_id": b, "name": b, "party": "p", "state": "s"} for b in "AB"]
    releases = [
        {"bioguide_id": "A", "member_name": "A", "text": "Apollo and Private Equity"},
        {"bioguide_id": "B", "member_name": "B", "text": "apollo private equity"},
        {"bioguide_id": "A", "member_name": "A", "text": "Apollo only"},
    ]
    found = lobbying.committee_say_vs_pay(
        table(spark, "lobbyists", people),
        table(spark, "lobbying_registrations", [filing("1", client_name="APOLLO Co", spend=3), filing("2", client_name="Other")]),
        table(spark, "committee_assignments", seats),
        table(spark, "legislators", members),
        table(spark, "press_releases", releases),
    )
    columns = ["lobbied_client", "lobbyist", "current_committee_members", "attack_press_releases", "committee_members_attacking"]
    assert rows(found, *columns) == [("APOLLO Co", "Yan", 1, 2, 1)]


def test_foreign_clients(spark):
    filings = [filing(str(i), client_country=" us") for i in range(2)] + [filing("f", client_country="France", client_name="F"), filing("n")]
    regs = table(spark, "lobbying_registrations", filings)
    assert rows(lobbying.foreign_clients(regs), "registration_id", "represented", "home_countries") == [("f", "F", "US")]
    declared = lobbying.foreign_clients(regs, home_countries="france | Spain")
    assert rows(declared, "registration_id", "home_countries") == [("0", "FRANCE|SPAIN"), ("1", "FRANCE|SPAIN")]


def test_former_official_lobbies_former_institution(spark):
    def worked(who, institution, end=None, registration="1"):
        return {"registration_id": registration, "lobbyist_id": who, "name": who, "former_public_office": "x",
                "former_office_institution": institution, "former_office_end": end}

    people = [
        worked("any", " Ministry of Trade "),
        worked("part", "Trade Ministry of Trade Office", "2024-01-01"),
        worked("late", "Ministry of Trade", "2024-02-02"),
        worked("short", "Trade"),
        worked("twice", "Ministry of Trade", "2023-12-01"),
        worked("twice", "Ministry of Trade", "2024-02-01"),
    ]

    def met(id, day, institution, official="Q"):
        return {"contact_id": id, "registrant_id": "L", "registrant_name": "N", "contact_date": day,
                "official_name": official, "institution": institution}

    contacts = [
        met("c1", "2024-01-10", "Ministry of Trade"), met("c1", "2024-01-10", "ministry of trade ", "P"),
        met("c2", "2024-02-01", "Ministry of Trade"), met("c3", "2024-02-01", "Other"),
    ]
    found = lobbying.former_official_lobbies_former_institution(
        table(spark, "lobbyists", people),
        table(spark, "lobbying_registrations", [filing("1")]),
        table(spark, "lobbying_contacts", contacts),
        max_days_after_leaving=50,
    )
    assert sorted(rows(found, "lobbyist_id", "contacts", "days_from_leaving_to_first_contact", "officials")) == [
        ("any", 2, None, "P | Q"),
        ("part", 2, 9, "P | Q"),
        ("twice", 2, -22, "P | Q"),
    ]


def test_contact_bursts(spark):
    def met(id, day, official="Q"):
        return {"contact_id": id, "registrant_id": "L", "contact_date": day, "official_name": official, "institution": "I"}

    contacts = [met(f"c{i}", "2024-01-05") for i in range(5)] + [met("c0", "2024-01-05", "P"), met("z", "2024-06-01")]
    found = lobbying.contact_bursts(table(spark, "lobbying_contacts", contacts))
    assert rows(found, "month", "contacts", "total_contacts", "active_months", "burst_ratio", "officials") == [
        (d("2024-01-01"), 5, 6, 6, 5.0, "P | Q")
    ]


# ------------------------------------------------------------------ parliamentary


def votings(spark, days):
    return table(
        spark, "parl_votings", [{"voting_id": f"v{i}", "parliament": "p", "vote_date": day, "chamber": "up"} for i, day in enumerate(days)]
    )


def cast(member, positions, group="G", parliament="p"):
    return [
        {"voting_id": f"v{i}", "parliament": parliament, "member_id": member, "position": position, "group_at_vote": group}
        for i, position in enumerate(positions)
    ]


def members(spark, *ids):
    return table(spark, "parl_members", [{"member_id": i, "parliament": "p", "name": f"Name {i}"} for i in ids])


def test_absence_outlier(spark):
    votes = cast("a", ["For"] * 10) + cast("b", ["against"] * 9 + ["ABSENT"]) + cast("c", ["absent"] * 4 + ["for"] * 6)
    votes += cast("e", ["absent"] * 3) + cast("f", ["absent"] * 10, parliament="q")
    found = parliamentary.absence_outlier(
        members(spark, "a", "b"), votings(spark, ["2024-01-01"] * 10), table(spark, "parl_member_votes", votes), min_votings=10
    )
    assert rows(found, "member_id", "name", "chamber", "absence_rate", "median_rate") == [("c", None, "up", 0.4, 0.1)]


def test_group_rebellion_rate(spark):
    line = ["for"] * 4
    votes = cast("a", line) + cast("b", line) + cast("c", ["FOR", "against", "for", "for"])
    votes += cast("t1", ["for"] * 4, "T") + cast("t2", ["against"] * 4, "T") + cast("t3", ["abstain"] * 4, "T")
    votes += cast("n", ["against"] * 4, "NI") + cast("s1", ["for"] * 4, "S") + cast("s2", ["against"] * 4, "S")
    found = parliamentary.group_rebellion_rate(
        members(spark, "c"), votings(spark, ["2024-01-01"] * 4), table(spark, "parl_member_votes", votes), min_votes=4
    )
    assert rows(found, "member_id", "name", "latest_group", "votes_compared", "rebellions", "rebellion_rate") == [
        ("c", "Name c", "G", 4, 1, 0.25)
    ]


def test_rebellion_rise(spark):
    days = ["2024-01-05", "2024-02-05", "2024-04-05", "2024-05-05"]
    votes = cast("a", ["for"] * 4) + cast("b", ["for"] * 4) + cast("e", ["for"] * 4) + cast("c", ["for", "for", "against", "for"])
    found = parliamentary.rebellion_rise(
        members(spark, "c"), votings(spark, days), table(spark, "parl_member_votes", votes), min_votes_per_period=2
    )
    assert rows(found, "member_id", "previous_period_start", "period_start", "previous_rate", "rate", "increase") == [
        ("c", d("2024-01-01"), d("2024-04-01"), 0.0, 0.5, 0.5)
    ]


def test_group_switch(spark):
    def span(member, org, start, end=None, term="1", kind="group"):
        return {"member_id": member, "parliament": "p", "affiliation_type": kind, "org_name": org, "start_date": start, "end_date": end, "term": term}

    spans = [
        span("a", "Red", "2020-01-01", "2020-06-01"), span("a", "Red", "2020-01-01", "2020-06-01"), span("a", "Blue", "2020-06-02"),
        span("b", "Red", "2020-01-01", "2020-06-01"), span("b", " red", "2020-06-02"),
        span("c", "Red", "2020-01-01"), span("c", "Blue", "2024-01-01", term="2"),
        span("f", "Red", "2020-01-01", "2022-12-31"), span("f", "Blue", "2023-01-01"), span("f", "Blue", "2023-03-01"),
        span("e", "Red", "2020-01-01", kind="party"), span("e", "Blue", "2021-01-01", kind="party"),
    ]
    found = parliamentary.group_switch(members(spark, "a"), table(spark, "parl_affiliations", spans), limit=100)
    assert rows(found, "member_id", "from_org", "to_org", "from_end", "switch_date") == [
        ("f", "Red", "Blue", d("2022-12-31"), d("2023-01-01")),
        ("a", "Red", "Blue", d("2020-06-01"), d("2020-06-02")),
    ]


def test_outside_interests_load(spark):
    def line(id, member, **extra):
        return {"interest_id": id, "member_id": member, "parliament": "p", "organisation": "o", **extra}

    lines = [line(str(i), "a", paid="Paid") for i in range(3)] + [line("0", "a", paid="paid"), line("9", "a", paid="paid", end_date="2020-01-01")]
    lines += [line("x", "b", income_high=120_000, paid="unpaid"), line("y", "c", paid="paid")]
    found = parliamentary.outside_interests_load(members(spark, "a"), table(spark, "parl_interests", lines), min_paid=3)
    assert rows(found, "member_id", "interests", "paid_interests", "unpaid_interests", "income_high") == [
        ("a", 3, 3, 0, None),
        ("b", 1, 0, 1, 120_000.0),
    ]


# ------------------------------------------------------------------ procurement


def process(id, buyer="b", method="open", **extra):
    return {"process_id": id, "buyer_id": buyer, "buyer_name": f"Buyer {buyer}", "procurement_method": method, **extra}


def test_single_bid_competitive(spark):
    processes = [process("1", number_of_tenderers=1, tender_value=5), process("1", number_of_tenderers=1, tender_value=9)]
    processes += [process("2", method="direct", number_of_tenderers=1), process("3", number_of_tenderers=2), process("4", method="Selective", number_of_tenderers=1)]
    found = procurement.single_bid_competitive(table(spark, "procurement_processes", processes))
    assert rows(found, "process_id", "tender_value") == [("1", 9.0), ("4", None)]


def test_short_submission_period(spark):
    def open_for(id, until, method="OPEN"):
        return process(id, method=method, tender_published_date="2024-01-10", tender_deadline=until)

    processes = [open_for("1", "2024-01-19"), open_for("2", "2024-01-20"), open_for("3", "2024-01-09"), open_for("4", "2024-01-10", None), open_for("5", "2024-01-11", "direct")]
    found = procurement.short_submission_period(table(spark, "procurement_processes", processes), limit=100)
    assert rows(found, "process_id", "submission_days") == [("4", 0), ("1", 9)]


def test_non_open_procedure_share(spark):
    processes = [process(f"a{i}", "a", "Limited" if i < 3 else "open") for i in range(5)] + [process("a9", "a", None), process("a0", "a", "Limited")]
    processes += [process(f"b{i}", "b", "open") for i in range(5)] + [process(f"c{i}", "c", "direct") for i in range(4)]
    found = procurement.non_open_procedure_share(table(spark, "procurement_processes", processes))
    columns = ["buyer_id", "processes", "unknown_method_processes", "non_open_processes", "non_open_share", "iqr_upper_fence", "above_iqr_fence"]
    assert rows(found, *columns) == [("a", 5, 1, 3, 0.6, 0.9, False)]


def award(id, supplier, value, process="p1", day="2024-05-05", **extra):
    return {"award_id": id, "process_id": process, "supplier_id": supplier, "supplier_name": supplier, "award_value": value, "award_date": day, **extra}


def test_supplier_share_outlier(spark):
    processes = table(spark, "procurement_processes", [process("p1", currency="EUR")])
    awards = [award(f"a{i}", "S", 100) for i in range(4)] + [award("joint", "S", 100), award("joint", "T", 100), award("joint", "T", 100)]
    awards += [award("usd", "U", 900, currency="USD"), award("zero", "V", 0), award("lost", "W", 10, process="none")]
    found = procurement.supplier_share_outlier(processes, table(spark, "procurement_awards", awards))
    columns = ["supplier_id", "currency", "supplier_value", "market_value", "supplier_share", "supplier_awards", "market_suppliers"]
    assert rows(found, *columns) == [("S", "EUR", 450.0, 500.0, 0.9, 5, 2)]


def test_supplier_shares_count_an_award_once_without_more_rows(spark):
    processes = table(spark, "procurement_processes", [process("p1", currency="EUR"), process("p2", "b2", currency="EUR")])
    awards = [award(f"a{i}", s, 100 if s == "S" else 10) for i in range(4) for s in ("S", "T", None)]
    awards += [award("a0", "S", 100, day="2023-05-05"), award(None, "S", 100), award("e", None, 10)]
    awards += [award(f"x{i}", s, 50, "p2") for i in range(4) for s in ("S", "T", "U")]  # twelve rows, four awards
    found = procurement.supplier_share_outlier(processes, table(spark, "procurement_awards", awards))
    columns = ["supplier_id", "award_year", "supplier_awards", "market_awards", "market_suppliers"]
    assert rows(found, *columns) == [("S", 2024, 4, 5, 2)]
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_value_growth_after_award(spark):
    processes = table(spark, "procurement_processes", [process("p1")])
    awards = [award("a", "S", 100), award("a", "T", 100), award("a", None, None, None, None, final_value=150)]
    awards += [award("b", "S", 100, final_value=120), award("c", "S", 100, final_value=121)]
    found = procurement.value_growth_after_award(processes, table(spark, "procurement_awards", awards))
    assert rows(found, "award_id", "buyer_id", "suppliers", "value_increase", "growth_ratio") == [
        ("a", "b", "S | T", 50.0, 1.5),
        ("c", "b", "S", 21.0, 1.21),
    ]


# ------------------------------------------------------------------ all of them


@pytest.mark.parametrize("released", [item for item in RELEASED if item.tables], ids=lambda item: item.id)
def test_empty_tables_give_no_lead(spark, released):
    assert released.run(*[table(spark, name) for name in released.tables]).count() == 0


def test_parameters_are_checked(spark):
    empty = table(spark, "companies")
    with pytest.raises(ParameterError):
        companies.rapid_dissolution(empty, max_days=-1)
    with pytest.raises(ParameterError):
        companies.rapid_dissolution(empty, max_days=True)
    with pytest.raises(ParameterError):
        companies.rapid_dissolution(empty, limit=0)


def test_limit_none_keeps_every_lead(spark):
    many = table(spark, "companies", [company(f"{i:04}", previous_name_count=7) for i in range(250)])
    assert companies.frequent_name_changes(many).count() == 250
    assert companies.frequent_name_changes(many, limit=200).count() == 200
