"""Contracts, readers, preparation, profiles, matching, leads, search and replay."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fixtures import rows, table
from leadspark.functions.ordered import distinct_in_forward_window, with_preceding_rows
from leadspark.functions.text import address_key, decimal_round, name_key, redact_text, registrant_key
from leadspark.functions.ordered import with_row_number
from leadspark.plans import leads, match, profile, registry, replay, search
from leadspark.sources import prepare, readers
from leadspark.sources.contracts import CONTRACTS, ContractError, contract_schema, load_contract, map_roles


# ------------------------------------------------------------------ functions


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def test_text_keys(spark):
    assert one(spark, name_key(F.lit("The Acme Corp. (N.Y.) Class A"))) == "ACME A"
    assert one(spark, name_key(F.lit(None).cast("string"))) == ""
    assert one(spark, registrant_key(F.lit("Hill & Knowlton, Inc."))) == one(
        spark, registrant_key(F.lit("HILL AND KNOWLTON INC"))
    )
    assert one(spark, address_key(F.lit("12, Élan-Straße"))) == "12élanstraße"


def test_redaction(spark):
    cases = {
        "api_key=abc, rest": "api_key=[redacted], rest",
        "Password: hunter2": "Password=[redacted]",
        "use Bearer abcdefgh123": "use Bearer [redacted]",
        "ghp_0123456789": "[redacted]",
        "see https://me:pw@host/x": "see https://[redacted]@host/x",
        "nothing here": "nothing here",
    }
    for before, after in cases.items():
        assert one(spark, redact_text(F.lit(before))) == after


def test_binary_rounding(spark):
    assert one(spark, decimal_round(F.lit(1.005), 2)) == 1.0
    assert one(spark, decimal_round(F.lit(2.675), 2)) == 2.68  # 2.675 * 100 is 267.5 in binary
    assert one(spark, decimal_round(F.lit(0.125), 2)) == 0.13


def test_preceding_rows_equal_one_global_window(spark):
    """Ranges smaller and larger than the window, and a timestamp that holds a third of the rows."""
    values = [(i, 500 if i % 3 == 0 else i * 7919 % 1000, float(i * 31 % 17)) for i in range(300)]
    df = spark.createDataFrame(values, "id long, at long, amount double")
    ordered = sorted(values, key=lambda row: (row[1], row[0]))
    for window, parts in ((1, 4), (5, 7), (40, 60)):
        result = with_preceding_rows(
            df, ["at", "id", "amount"], window, {"mean": F.avg("amount"), "last": F.last("amount")}, partitions=parts
        )
        found = {row.id: (row.mean, row.last) for row in result.collect()}
        assert len(found) == 300
        for i, (id, _, _) in enumerate(ordered):
            before = [row[2] for row in ordered[max(0, i - window) : i]]
            mean, last = found[id]
            assert last == (before[-1] if before else None)
            assert mean is None if not before else abs(mean - sum(before) / len(before)) < 1e-9


def test_distinct_members_in_a_window_equal_brute_force(spark):
    values = [(f"k{i % 2}", (i * 37) % 60, f"m{i * 13 % 7}" if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(values, "key string, day int, member string")
    for window in (0, 3, 20):
        found = {
            (row.key, row.day): row._members
            for row in distinct_in_forward_window(df, ["key"], "day", "member", window).collect()
        }
        for key, day, _ in values:
            members = {m for k, d, m in values if k == key and day <= d <= day + window and m is not None}
            assert found[(key, day)] == len(members)


# ------------------------------------------------------------------ contracts and registry


def test_contract_schemas():
    names = [name for tables in CONTRACTS.values() for name in tables]
    assert len(names) == len(set(names)) == 26
    donation = contract_schema("donations")
    assert donation["amount"].dataType.typeName() == "double"
    assert donation["donation_date"].dataType.typeName() == "date"
    assert donation["donor_postcode"].metadata["optional"] and not donation["donor_name"].metadata["optional"]


def test_load_contract(spark):
    raw = spark.createDataFrame([("1", "R", "n", "d", "12.5", "2024-01-02", "x")], "id string, rid string, rn string, dn string, amt string, day string, extra string")
    mapping = {"donation_id": "id", "recipient_id": "rid", "recipient_name": "rn", "donor_name": "dn", "amount": "amt", "donation_date": "day"}
    loaded = load_contract(raw, "donations", mapping)
    assert loaded.columns == contract_schema("donations").names
    assert loaded.first().asDict() | {} == {
        **{name: None for name in loaded.columns},
        "donation_id": "1", "recipient_id": "R", "recipient_name": "n", "donor_name": "d", "amount": 12.5,
        "donation_date": dt.date(2024, 1, 2),
    }
    with pytest.raises(ContractError, match="donor_name"):
        load_contract(raw, "donations", {k: v for k, v in mapping.items() if k != "donor_name"})
    with pytest.raises(ContractError, match="nope"):
        load_contract(raw, "donations", {"nope": "id"})
    bad = raw.withColumn("amt", F.lit("many"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_contract(bad, "donations", mapping).collect()


def test_map_roles(spark):
    raw = spark.createDataFrame([(1, 2.0, "z")], "a long, b double, c string")
    assert map_roles(raw, ["id", "amount"], {"id": "a", "amount": "b"}).columns == ["id", "amount"]
    with pytest.raises(ContractError, match="unmapped"):
        map_roles(raw, ["id", "amount"], {"id": "a"})
    with pytest.raises(ContractError, match="not in the table"):
        map_roles(raw, ["id"], {"id": "q"})


def test_registry():
    found = registry.detectors()
    assert len(registry.RELEASED) == 45 and set(found) == {item.id for item in registry.RELEASED}
    per_domain = {}
    for item in registry.RELEASED:
        per_domain[item.category] = per_domain.get(item.category, 0) + 1
    assert per_domain == {
        "statistical": 6, "campaign_finance": 3, "companies": 6, "court": 5, "lobbying": 15, "parliamentary": 5, "procurement": 5,
    }


def test_run_detectors(spark):
    gifts = spark.createDataFrame([(i, 100.0 + i, dt.date(2024, 1, 1)) for i in range(9)] + [(9, 9000.0, dt.date(2024, 3, 1))], "n long, amt double, day date")
    requests = [
        {"id": "numeric.zscore_outliers", "fields": {"id": "n", "amount": "amt"}, "parameters": {"z_threshold": 5.0}},
        {"id": "temporal.coverage_gaps", "fields": {"id": "n", "observed_at": "day"}},
    ]
    found = registry.run_detectors(gifts, requests, provenance={"input_hash": "sha256:x"})
    assert sorted(rows(found, "detector_id", "candidate_id")) == [
        ("numeric.zscore_outliers", "row-9"),
        ("temporal.coverage_gaps", "gap-2024-01-01"),
    ]
    with pytest.raises(registry.RequestError):
        registry.run_detectors(gifts, [])
    with pytest.raises(registry.RequestError):
        registry.run_detectors(gifts, [requests[0], requests[0]])
    with pytest.raises(registry.RequestError):
        registry.run_detectors(gifts, [{"id": "companies.rapid_dissolution"}])
    with pytest.raises(registry.RequestError):
        registry.run_detectors({"donations": gifts}, [requests[0]])
    with pytest.raises(registry.RequestError):
        registry.run_detectors({}, [{"id": "companies.rapid_dissolution"}])


def test_user_detector(spark):
    registry.register_detector(
        "user.large_gifts", "SELECT donation_id AS candidate_id, amount FROM {donations} WHERE amount > :least", tables=["donations"]
    )
    try:
        donations = table(spark, "donations", [{"donation_id": "1", "amount": 5}, {"donation_id": "2", "amount": 50}])
        found = registry.run_detectors({"donations": donations}, [{"id": "user.large_gifts", "parameters": {"least": 10}}])
        assert rows(found, "candidate_id", "category") == [("2", "user")]
        with pytest.raises(registry.RequestError):
            registry.register_detector("user.large_gifts", "SELECT 1", tables=["donations"])
    finally:
        registry.unregister_detector("user.large_gifts")
    with pytest.raises(registry.RequestError):
        registry.unregister_detector("numeric.level_shift")


# ------------------------------------------------------------------ sources and preparation


def test_readers_agree_on_one_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name\n1,"a, b"\n2,c\n')
    (tmp_path / "t.json").write_text('[{"id": "1", "name": "a, b"}, {"id": "2", "name": "c"}]')
    (tmp_path / "t.jsonl").write_text('{"id": "1", "name": "a, b"}\r\n\r\n{"id": "2", "name": "c"}\r\n')
    (tmp_path / "t.xml").write_text('<rows><row id="1"><name>a, b</name></row><row id="2"><name>c</name></row></rows>')
    readers.read_csv(spark, str(tmp_path / "t.csv")).write.parquet(str(tmp_path / "t.parquet"))
    expected = [("1", "a, b"), ("2", "c")]
    for read, name in (
        (readers.read_csv, "t.csv"), (readers.read_json, "t.json"), (readers.read_jsonl, "t.jsonl"),
        (readers.read_xml, "t.xml"), (readers.read_parquet, "t.parquet"),
    ):
        assert sorted(rows(read(spark, str(tmp_path / name)).select("id", "name"), "id", "name")) == expected, name
    assert readers.read_table(spark, str(tmp_path / "t.csv")).dtypes == [("id", "int"), ("name", "string")]
    with pytest.raises(readers.SourceError):
        readers.read_table(spark, "t.xlsx")


def test_csv_is_split_unless_quotes_hold_line_breaks(spark, tmp_path):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text('id,note\n1,"say ""no"", please"\n2,x\n')
    broken.write_text('id,note\n1,"two\nlines, ""quoted"""\n2,x\n')
    assert not readers._breaks_in_quotes(spark, str(plain)) and readers._breaks_in_quotes(spark, str(broken))
    assert sorted(map(tuple, readers.read_csv(spark, str(plain)).collect())) == [("1", 'say "no", please'), ("2", "x")]
    assert sorted(map(tuple, readers.read_csv(spark, str(broken)).collect())) == [("1", 'two\nlines, "quoted"'), ("2", "x")]


def test_instants_without_a_zone_are_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    texts = ["2024-03-01", "2024-03-01T12:30", "2024-03-01 12:30:15.5", "2024-03-01T12:30Z", "2024-03-01T12:30+02:00"]
    want = [1709251200, 1709296200, 1709296215.5, 1709296200, 1709289000]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn(
            "n", F.when(F.col("i") == 0, F.lit("2024-03-01 00:00:00")).cast("timestamp_ntz")
        )
        made = prepare.convert_types(frame, {"i": "integer", "t": "datetime", "n": "datetime"})
        seen = made.orderBy("i").select(F.unix_micros("t") / 1e6, F.unix_micros("n") / 1e6).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [row[0] for row in seen] == want and seen[0][1] == want[0]


def test_strict_sources(spark, tmp_path):
    (tmp_path / "repeat.csv").write_text("a,a\n1,2\n")
    with pytest.raises(readers.SourceError, match="repeats"):
        readers.read_csv(spark, str(tmp_path / "repeat.csv"))
    (tmp_path / "ragged.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.read_csv(spark, str(tmp_path / "ragged.csv")).collect()
    (tmp_path / "nan.json").write_text('[{"a": NaN}]')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed|parse"):
        readers.read_json(spark, str(tmp_path / "nan.json")).collect()
    spark.createDataFrame([([1],)], "a array<int>").write.parquet(str(tmp_path / "nested.parquet"))
    with pytest.raises(readers.SourceError, match="nested"):
        readers.read_parquet(spark, str(tmp_path / "nested.parquet"))


def test_union_records(spark):
    left = spark.createDataFrame([(1, "x")], "a long, b string")
    right = spark.createDataFrame([("y", 2.0)], "b string, c double")
    assert rows(readers.union_records(left, right), "a", "b", "c") == [(1, "x", None), (None, "y", 2.0)]


def test_type_inference(spark):
    df = spark.createDataFrame(
        [
            ("1", "1", "2024-01-01", "007", "1.5", None, "true", "9" * 30, "2024-01-01T10:00:00+02:00", "x"),
            ("-20", "2.5e3", "2024-02-03", "8", "nan", " ", "false", "1", "2024-01-02", "1"),
        ],
        "i string, f string, d string, z string, n string, e string, b string, big string, ts string, t string",
    )
    cleaned = prepare.clean_values(df)
    types = prepare.infer_types(cleaned)
    assert types == {
        "i": "integer", "f": "float", "d": "datetime", "z": "float", "n": "text", "e": "text", "b": "text", "big": "float",
        "ts": "datetime", "t": "text",
    }
    row = prepare.convert_types(cleaned, types).orderBy("i").collect()[1]
    assert (row.i, row.f, row.z) == (1, 1.0, 7.0)
    # 10:00 in a zone two hours ahead is 08:00 UTC.
    seen = prepare.convert_types(cleaned, types).select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("v"))
    assert sorted(rows(seen, "v")) == [("2024-01-01 08:00",), ("2024-01-02 00:00",)]


def test_long_codes_of_the_type_query_stay_whole(spark, tmp_path):
    from leadspark.testbed.plan_queries import _infer_types

    users = [7, 9999, 10_000, 89_999]
    events = spark.createDataFrame([(i, dt.datetime(2024, 1, 1), u, "view", 1.0) for i, u in enumerate(users)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(rows(_infer_types(spark, str(tmp_path)), "id", "code")) == [(i, float(u)) for i, u in enumerate(users)]


def test_nested_values_become_text(spark):
    df = spark.createDataFrame([([1, 2], {"k": "v"}, " x ")], "a array<int>, m map<string,string>, s string")
    assert rows(prepare.prepare(df), "a", "m", "s") == [("[1,2]", '{"k":"v"}', "x")]


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "x", 10.0, 20.0), (2, None, "x", None, 5.0), (2, None, "x", None, 5.0)],
        "id long, v double, t string, lat double, lon double",
    )
    found = {row.field: row for row in profile.field_metrics(df).collect()}
    assert (found["v"].missing_count, round(found["v"].missing_fraction, 4), found["v"].cardinality) == (2, 0.6667, 1)
    assert (found["id"].min_value, found["id"].max_value, found["t"].min_value) == ("1", "2", None)
    assert profile.duplicate_row_count(df).first().duplicate_rows == 1
    assert rows(profile.value_distribution(df.select("id")), "value", "count") == [("2", 2), ("1", 1)]
    assert rows(profile.geographic_coverage(df, "lat", "lon"), "row_count", "min_longitude") == [(1, 20.0)]
    assert profile.temporal_coverage(df.withColumn("at", F.lit(None).cast("timestamp")), "at").count() == 0
    empty = {row.field: row.missing_fraction for row in profile.field_metrics(df.limit(0)).collect()}
    assert set(empty.values()) == {0.0}
    assert profile.copy_differences(df, df).count() == 0
    with pytest.raises(ValueError):
        profile.copy_differences(df, df.drop("t"))


def test_matching(spark):
    fields = [("t", "orders", "id", "integer", 0.0), ("t", "orders", "amount", "float", 0.2), ("t", "orders", "group", "integer", 0.0),
              ("u", "donations", "x", "text", 0.0), ("w", "other", "observed_at", "datetime", 0.3), ("w", "other", "id", "text", 0.0)]
    profiles = spark.createDataFrame(fields, "table_id string, table_name string, field string, type string, missing_fraction double")
    scored, needed = match.requirement_rows(spark, registry.detectors())
    found = {row.detector_id: row for row in match.match_detectors(profiles, scored, needed).collect()}
    assert round(found["numeric.zscore_outliers"].data_fit, 4) == 0.9
    assert "required type" in found["categorical.rare_levels"].blocked_reason
    assert "coverage" in found["temporal.coverage_gaps"].blocked_reason
    assert found["campaign_finance.structured_gifts"].compatible_tables == 1
    assert "required table" in found["companies.rapid_dissolution"].blocked_reason
    order = match.recommend(match.match_detectors(profiles, scored, needed), max_detectors=3)
    assert rows(order, "detector_id") == [("table.duplicate_rows",), ("numeric.zscore_outliers",), ("campaign_finance.maxed_donor_clusters",)]


# ------------------------------------------------------------------ leads, search, replay


@pytest.fixture(scope="module")
def evidence(spark):
    found = spark.createDataFrame(
        [("c1", "outlier", 5.0, "Ann Lee"), ("c2", "outlier", 9.0, "token=abcdef"), ("c3", "gap", 7.0, None)],
        "candidate_id string, category string, score double, name string",
    ).withColumn("api_key", F.lit("hidden"))
    return leads.leads_with_evidence(
        found, registry.detector("numeric.zscore_outliers"), table_id="t", source_id="s", source_hash="h", run_id="r1",
        order=[F.col("score").desc()], run_date="2026-01-02",
    )


def test_evidence_leads(evidence):
    assert rows(evidence, "candidate_id", "rank", "statement") == [
        ("c2", 1, "outlier lead for c2"),
        ("c3", 2, "gap lead for c3"),
        ("c1", 3, "outlier lead for c1"),
    ]
    preview = json.loads(evidence.filter("rank = 1").first().preview)
    assert "api_key" not in preview and preview["name"] == "token=[redacted]"


def test_lead_identity_and_redaction(spark):
    found = spark.createDataFrame([("reg", "a", "x")], "register string, registrant string, secret string")
    wrapped = leads.to_leads(found, registry.detector("lobbying.foreign_clients"), provenance={"input_hash": "sha256:1"}).first()
    assert wrapped.candidate_id == "reg" and json.loads(wrapped["values"])["secret"] == "[redacted]"
    other = leads.to_leads(found, registry.detector("lobbying.foreign_clients"), provenance={"input_hash": "sha256:2"}).first()
    assert wrapped.signal_id != other.signal_id and wrapped.signal_id.startswith("signal-") and len(wrapped.signal_id) == 31


def test_fingerprint_ignores_order_but_not_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i long, s string")
    assert leads.fingerprint(df).first() == leads.fingerprint(df.orderBy(F.col("i").desc())).first()
    assert leads.fingerprint(df).first().fingerprint != leads.fingerprint(df.union(df).union(df)).first().fingerprint
    assert leads.fingerprint(df.limit(0)).first().rows == 0


def test_write_leads_can_be_repeated(spark, evidence, tmp_path):
    path = str(tmp_path / "leads")
    other = evidence.filter("rank = 1").withColumn("run_id", F.lit("run 2/b"))
    for run in (evidence, other, evidence, other):
        leads.write_leads(run, path)
    again = leads.read_leads(spark, path, evidence.schema)
    assert again.columns == evidence.columns
    assert sorted(again.select("run_id", "candidate_id").collect()) == sorted(
        evidence.unionByName(other).select("run_id", "candidate_id").collect()
    )
    assert (tmp_path / "leads" / "detector_id=numeric.zscore_outliers" / "run_id=r1").is_dir()
    leads.write_leads(evidence.limit(1), path)  # fewer leads replace more, other runs stay
    assert again.sparkSession.read.parquet(path).groupBy("run_id").count().collect() != []
    assert leads.read_leads(spark, path, evidence.schema).count() == 2
    for _ in range(2):
        leads.write_leads(evidence, str(tmp_path / "json"), format="json")
    assert leads.read_leads(spark, str(tmp_path / "json"), evidence.schema, format="json").count() == 3
    with pytest.raises(ValueError):
        leads.write_leads(evidence.drop("run_id"), path)
    with pytest.raises(ValueError):
        leads.write_leads(evidence, path, format="csv")


@pytest.mark.parametrize("partitions", [1, 6])
def test_row_numbers_without_a_single_task(spark, partitions):
    values = [(i * 37 % 101, i) for i in range(300)]
    order = [F.col("v").desc(), F.col("i")]
    numbered = with_row_number(spark.createDataFrame(values, "v long, i long"), order, "n", partitions=partitions)
    want = {i: n for n, (_, i) in enumerate(sorted(values, key=lambda x: (-x[0], x[1])), 1)}
    assert {row.i: row.n for row in numbered.collect()} == want
    assert numbered.limit(0).count() == 0


def test_search(spark, evidence):
    table_ = search.build_search_rows(evidence, search.detector_rows(spark, registry.detectors())).cache()
    search.assert_unique(evidence, ["signal_id", "run_id"])
    with pytest.raises(search.SearchError):
        search.assert_unique(evidence.union(evidence), ["signal_id", "run_id"])
    both = search.search(table_, "Outlier LEAD").collect()
    assert len(both) == 2 and both[0].matched_on == ["statement"]
    assert search.search(table_, "ann gap").count() == 0  # the terms are in different fields
    assert search.search(table_, "lee").first().matched_on == ["preview.name"]
    assert search.search(table_, "outliers").first().query_score == 1
    assert {row.query_score for row in search.search(table_).collect()} == {0}
    assert search.search(table_, "lead", filters={"date": "2026-01-02", "category": "gap"}).count() == 1
    assert search.search(table_, "lead", filters={"severity": "high"}).count() == 0
    first = search.search(table_, "lead", limit=2).collect()
    cursor = search.encode_cursor(first[-1], "lead", {})
    rest = search.search(table_, "lead", limit=2, cursor=cursor).collect()
    assert len(rest) == 1 and {row.signal_id for row in first} & {rest[0].signal_id} == set()
    for bad in ({"filters": {"color": "red"}}, {"filters": {"date": "2026-13-01"}}, {"limit": 0}, {"limit": 101}, {"cursor": "x"}):
        with pytest.raises(search.SearchError):
            search.search(table_, "lead", **bad)
    with pytest.raises(search.SearchError):
        search.search(table_, "other", cursor=cursor)


def test_replay_and_findings(spark, evidence):
    runs = spark.createDataFrame(
        [("r1", "numeric.zscore_outliers", "", "t"), ("r2", "numeric.level_shift", "", "t")],
        "run_id string, detector_id string, detector_hash string, table_id string",
    )
    tables = spark.createDataFrame([("t", "s", "h")], "table_id string, source_id string, source_hash string")
    assert sorted(rows(replay.replay(evidence, runs, tables), "run_id", "signal_count", "unbound_count")) == [("r1", 3, 0), ("r2", 0, 0)]
    moved = tables.withColumn("source_hash", F.lit("changed"))
    assert replay.binding_errors(evidence, runs, moved).count() == 3
    assert replay.differences(evidence, evidence).count() == 0
    changed = evidence.filter("candidate_id <> 'c1'")
    assert rows(replay.differences(evidence, changed), "candidate_id", "change") == [("c1", "missing")]
    merged = evidence.withColumn("claim_id", F.when(F.col("category") == "outlier", "claim-x"))
    claims = replay.draft_findings(merged)
    found = {row.claim_id: row for row in claims.collect()}
    assert (found["claim-x"].rank, len(found["claim-x"].signal_ids), found["claim-x"].statement) == (1, 2, "outlier lead for c2")
    assert len(found) == 2
    assert rows(replay.category_counts(claims), "label", "claims") == [("gap", 1), ("outlier", 1)]
    counted = replay.replay(evidence, runs, tables)
    assert rows(replay.detector_counts(counted), "detector_id", "signals") == [("numeric.level_shift", 0), ("numeric.zscore_outliers", 3)]


def test_recompute(spark):
    cases = [
        ("ratio", 0.5, 1.0, 2.0, None, None, True),
        ("percentage", 0.6, 1.0, 2.0, None, None, False),
        ("ratio", 0.5, 1.0, 0.0, None, None, False),
        ("ratio", 0.5, None, 2.0, None, None, False),
        ("ratio", 0.5, float("nan"), 2.0, None, None, False),
        ("count", 3.0, None, None, 3, None, True),
        ("count", 3.0, None, None, -3, None, False),
        ("sum", 4.0, None, None, None, [1.0, 3.0], True),
        ("mean", 2.0, None, None, None, [1.0, 3.0], True),
        ("mean", 2.0, None, None, None, [], False),
        ("sum", None, None, None, None, [1.0], False),
        ("other", 1.0, None, None, None, None, False),
        (None, 1.0, None, None, None, None, False),
    ]
    df = spark.createDataFrame(
        cases, "kind string, value double, numerator double, denominator double, count long, values array<double>, want boolean"
    )
    assert replay.recompute(df).filter("ok <> want").count() == 0
    values = spark.createDataFrame(
        [("b", "ratio", 2.0, 2), ("a", "ratio", 1.0, 2), ("c", "zscore", 1.0, 1), ("d", "percentage", None, 1)],
        "claim_id string, calculation_kind string, calculation_value double, rank int",
    )
    assert rows(replay.comparable_values(values), "claim_id") == [("a",), ("b",)]
