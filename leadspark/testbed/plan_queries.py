"""Preparation, profiling, leads, search and replay over whole test tables, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.functions.text import BEARER_TOKEN, SECRET_ASSIGNMENT, TOKEN_PREFIX, URL_USERINFO, redact_text
from leadspark.operators import statistical
from leadspark.plans import leads, match, profile, replay, search, search_index
from leadspark.plans.registry import detector, detectors
from leadspark.sources.contracts import load_contract
from leadspark.session import shared_folder
from leadspark.sources.prepare import clean_values, convert_types, infer_types
from leadspark.testbed.queries import Query, read, rounded


def _load_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "process_id": "o_orderkey", "buyer_id": "o_custkey", "buyer_name": "o_orderpriority", "country": "o_orderstatus",
        "tender_value": "o_totalprice", "tender_published_date": "o_orderdate",
    }
    return rounded(load_contract(read(spark, sf_dir, "orders"), "procurement_processes", columns))


def _redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", redact_text("text").alias("text"))


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the text a CSV file would hold."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")).alias("amount"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("observed_at"),
        F.when(F.col("user_id") % 7 == 0, F.lit("  ")).otherwise(F.col("event_type")).alias("name"),
        # Four digits at least; lpad alone would cut longer numbers.
        F.lpad(F.col("user_id").cast("string"), F.greatest(F.lit(4), F.length(F.col("user_id").cast("string"))), "0").alias("code"),
    )


def _infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean_values(_raw_events(spark, sf_dir))
    converted = convert_types(cleaned, infer_types(cleaned))
    return rounded(
        converted.withColumn("observed_at", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )


def _profiled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderpriority",
    )


def _field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.field_metrics(_profiled_orders(spark, sf_dir), table_id="orders"))


def _value_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_distribution(read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey"))


def _duplicate_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_row_count(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


def _temporal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = profile.temporal_coverage(read(spark, sf_dir, "events"), "ts")
    return covered.select("field", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))


def _geographic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = read(spark, sf_dir, "customer").select(
        (F.col("c_acctbal") / 200.0).alias("lat"),
        F.when(F.col("c_nationkey") > 2, F.col("c_nationkey") * 7.0).alias("lon"),
    )
    return rounded(profile.geographic_coverage(places, "lat", "lon"))


def _copy_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    damaged = original.withColumn(
        "o_orderstatus", F.when(F.col("o_orderpriority") == "5-LOW", F.lit("F")).otherwise(F.col("o_orderstatus"))
    )
    found = profile.copy_differences(original, damaged)
    return found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("rows"))


def _match(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {
        "events": read(spark, sf_dir, "events").select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("observed_at"),
            F.when(F.col("event_type") == "view", None).otherwise(F.col("value")).alias("amount"),
        ),
        "orders": read(spark, sf_dir, "orders").select(
            F.col("o_orderpriority").alias("group"),
            F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("amount"),
        ),
        "donations": read(spark, sf_dir, "customer").select(F.col("c_name").alias("donor_name")),
    }
    profiles = None
    for name, table in tables.items():
        one = profile.field_metrics(table, table_id=f"t-{name}").withColumn("table_name", F.lit(name))
        profiles = one if profiles is None else profiles.unionByName(one)
    scored, needed = match.requirement_rows(spark, detectors())
    return match.match_detectors(profiles, scored, needed)


def _match_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        _match(spark, sf_dir).select("detector_id", "data_fit", "compatible_tables", F.col("blocked_reason").isNotNull().alias("blocked"))
    )


def _recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        match.recommend(_match(spark, sf_dir)).select("detector_id", "detector_group", "rank_in_group", "score")
    )


def _zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return statistical.zscore_outliers(events.select(F.col("event_id").alias("id"), F.col("value").alias("amount")))


def _to_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = leads.to_leads(
        _zscores(spark, sf_dir), detector("numeric.zscore_outliers"), provenance={"input_hash": "events"}
    )
    return wrapped.select(
        "status", "signal_id", "detector_id", "candidate_id", "category", "severity", "summary",
        F.get_json_object("values", "$.category").alias("row_category"),
    )


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.leads_with_evidence(
        _zscores(spark, sf_dir),
        detector("numeric.zscore_outliers"),
        table_id="t-events",
        source_id="s-events",
        source_hash="h",
        run_id="r1",
        order=[F.col("amount").desc(), F.col("candidate_id")],
        run_date="2026-01-01",
    )


def _leads_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select(
        "signal_id", "run_id", "candidate_id", "category", "statement", "rank",
        F.col("evidence_refs")[0]["table_id"].alias("evidence_table"), "review_state",
    )


def _write_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs in one lead table, the first of them written again after the second."""
    found = _evidence(spark, sf_dir)
    second = found.filter("rank % 2 = 0").withColumn("run_id", F.lit("r2"))
    folder = shared_folder(spark, "leads")
    for run in (found, second, found):
        leads.write_leads(run, folder)
    return leads.read_leads(spark, folder, found.schema).select(
        "signal_id", "run_id", "detector_id", "candidate_id", "category", "severity", "statement", "rank", "review_state"
    )


def _leads_with_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"t1": {"source_id": "s1", "source_hash": "h1"}, "t2": {"source_id": "s2", "source_hash": "h2"}}
    found = leads.leads_with_lineage(
        _zscores(spark, sf_dir), detector("numeric.zscore_outliers"), tables, run_id="r1", parameters={"z_threshold": 3.0}
    )
    return found.select(
        "signal_id", "candidate_id", "table_id", "category", F.size("evidence_refs").cast("long").alias("evidence"),
        F.col("provenance.table_sources")["t2"]["source_hash"].alias("second_hash"),
        F.col("provenance.parameters")["z_threshold"].alias("z_threshold"),
    )


def _fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.fingerprint(read(spark, sf_dir, "lineitem"))


def _document_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.lit("text.documents").alias("detector_id"),
        F.format_string("signal-%06d", "doc_id").alias("signal_id"),
        F.col("source").alias("run_id"),
        F.col("lang").alias("category"),
        F.col("text").alias("statement"),
        F.to_json(F.struct("lang", "source")).alias("preview"),
    )


def _search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = spark.createDataFrame(
        [("text.documents", "text", "Documents", "Texts of the source", "", "")],
        "detector_id string, detector_group string, title string, description string, assumptions string, "
        "false_positives string",
    )
    return search.build_search_rows(_document_leads(spark, sf_dir), described)


def _build_search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search_rows(spark, sf_dir).groupBy("field", "detector_group").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("text") == "").alias("empty")
    )


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = search.match_terms(
        search.filter_leads(_search_rows(spark, sf_dir), category="en"), "  The SRC1 source "
    ).unionByName(search.match_terms(search.filter_leads(_search_rows(spark, sf_dir), category="fr"), "Le un"))
    return matched.withColumn("matched_on", F.array_join("matched_on", ","))


# Query and language of the searches over the postings.
INDEXED = (("The SRC1 source", "en"), ("thanedble ing", None), ("Le un", "fr"), ("no-such-word", None), ("É", "es"))


def _search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search_index.write_index(_search_rows(spark, sf_dir), shared_folder(spark, "search-index"))
    found = None
    for query, lang in INDEXED:
        one = search_index.match_indexed(index, query, **({"category": lang} if lang else {}))
        one = one.select("*", F.lit(query).alias("query"))
        found = one if found is None else found.unionByName(one)
    return found.withColumn("matched_on", F.array_join("matched_on", ","))


def _search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search, reached by the cursor of the first page's last row."""
    rows = _search_rows(spark, sf_dir)
    first = search.search(rows, "en", filters={"group": "text"}, limit=50).collect()
    if not first:
        return search.search(rows, "en", filters={"group": "text"}, limit=50).drop("matched_on")
    cursor = search.encode_cursor(first[-1], "en", {"group": "text"})
    return search.search(rows, "en", filters={"group": "text"}, limit=50, cursor=cursor).drop("matched_on")


def _calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    number, price, tax = F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_tax")
    pair = F.array(price, tax)
    wrong = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    return lines.select(
        F.element_at(
            F.array(*[F.lit(kind) for kind in ("ratio", "difference", "zscore", "count", "sum", "mean", "guess")]), number
        ).alias("kind"),
        price.alias("numerator"),
        tax.alias("denominator"),
        price.alias("current"),
        tax.alias("previous"),
        price.alias("value_input"),
        F.lit(10.0).alias("mean"),
        (F.col("l_discount") * 100.0).alias("stddev"),
        F.col("l_suppkey").alias("count"),
        pair.alias("values"),
        (
            F.when(number == 1, F.try_divide(price, tax))
            .when(number == 2, price - tax)
            .when(number == 3, F.try_divide(price - 10.0, F.col("l_discount") * 100.0))
            .when(number == 4, F.col("l_suppkey").cast("double"))
            .when(number == 5, price + tax)
            .otherwise((price + tax) / 2)
            + wrong
        ).alias("value"),
    )


def _recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = replay.recompute(_calculations(spark, sf_dir))
    return checked.groupBy("kind", "ok", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def _event_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("signal-"), F.col("event_id").cast("string")).alias("signal_id"),
        F.col("event_type").alias("run_id"),
        F.lit("d").alias("detector_id"),
        F.lit("h").alias("detector_hash"),
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("table_id"),
        F.lit("s").alias("source_id"),
        F.when(F.col("user_id") % 4 == 2, "bad").otherwise("good").alias("source_hash"),
    )


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are the event types; table t3 belongs to no run, and table t2 has another source hash."""
    runs = read(spark, sf_dir, "events").select("event_type").distinct()
    runs = runs.select(
        F.col("event_type").alias("run_id"),
        F.lit("d").alias("detector_id"),
        F.lit("h").alias("detector_hash"),
        F.explode(F.array(F.lit("t0"), F.lit("t1"), F.lit("t2"))).alias("table_id"),
    )
    tables = runs.select("table_id", F.lit("s").alias("source_id"), F.lit("good").alias("source_hash")).distinct()
    found = replay.replay(_event_leads(spark, sf_dir), runs, tables)
    return found.withColumn("table_ids", F.array_join("table_ids", ","))


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _event_leads(spark, sf_dir)
    after = before.withColumn("source_hash", F.when(F.col("run_id") == "view", "new").otherwise(F.col("source_hash")))
    return replay.differences(before, after).groupBy("run_id", "change").agg(F.count(F.lit(1)).alias("rows"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.concat(F.lit("claim-"), F.col("l_suppkey").cast("string"))).alias("claim_id"),
        F.concat(F.lit("signal-"), F.col("l_orderkey").cast("string")).alias("signal_id"),
        F.col("l_linestatus").alias("run_id"),
        F.col("l_linenumber").alias("rank"),
        F.concat(F.lit("lead for "), F.col("l_orderkey").cast("string")).alias("statement"),
        F.col("l_returnflag").alias("category"),
        F.lit("{}").alias("preview"),
        F.lit("h").alias("source_hash"),
        F.lit("d").alias("detector_hash"),
        F.array(F.struct(F.col("l_returnflag").alias("table_id"))).alias("evidence_refs"),
    )
    return replay.draft_findings(lines)


def _draft_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select(
        "claim_id", "rank", "status", F.array_join("categories", ",").alias("categories"),
        F.array_join("run_ids", ",").alias("run_ids"), F.size("signal_ids").cast("long").alias("signals"),
        F.size("evidence_refs").cast("long").alias("references"),
    )


def _category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.category_counts(_claims(spark, sf_dir))


def _comparable_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    claims = orders.select(
        F.concat(F.lit("claim-"), F.col("o_orderkey").cast("string")).alias("claim_id"),
        F.when(F.col("o_orderstatus") == "F", "ratio").when(F.col("o_orderstatus") == "O", "sum").alias("calculation_kind"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("calculation_value"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("rank"),
    )
    return rounded(replay.comparable_values(claims))


def _detector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("detector_id"), F.floor("value").cast("long").alias("signal_count")
    )
    return replay.detector_counts(runs)


PLAN_QUERIES: dict[str, Query] = {
    "contract.load_contract": _load_contract,
    "prepare.redact_text": _redact,
    "prepare.infer_types": _infer_types,
    "profile.field_metrics": _field_metrics,
    "profile.value_distribution": _value_distribution,
    "profile.duplicate_row_count": _duplicate_row_count,
    "profile.temporal_coverage": _temporal_coverage,
    "profile.geographic_coverage": _geographic_coverage,
    "profile.copy_differences": _copy_differences,
    "match.match_detectors": _match_detectors,
    "match.recommend": _recommend,
    "leads.to_leads": _to_leads,
    "leads.with_evidence": _leads_with_evidence,
    "leads.write_leads": _write_leads,
    "leads.with_lineage": _leads_with_lineage,
    "leads.fingerprint": _fingerprint,
    "search.build_search_rows": _build_search_rows,
    "search.match_terms": _search,
    "search.match_indexed": _search_indexed,
    "search.page": _search_page,
    "replay.recompute": _recompute,
    "replay.replay": _replay,
    "replay.differences": _differences,
    "replay.draft_findings": _draft_findings,
    "report.category_counts": _category_counts,
    "report.comparable_values": _comparable_values,
    "report.detector_counts": _detector_counts,
}


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FLAGGED = """
s AS (SELECT sum(value) AS total, sum(value * value) AS squares, count(*) AS n FROM events),
flagged AS (
    SELECT 'row-' || CAST(event_id AS VARCHAR) AS candidate_id, value AS amount FROM events, s
    WHERE abs(value - (total - value) / (n - 1))
          >= 3 * sqrt((squares - value * value) / (n - 1) - ((total - value) / (n - 1)) * ((total - value) / (n - 1)))
)"""


def _signal(key: str) -> str:
    return f"'signal-' || substr(sha256({key}), 1, 24)"


def _metric(field: str, kind: str, value: str, ranged: bool) -> str:
    low, high = (f"CAST(min({value}) AS VARCHAR)", f"CAST(max({value}) AS VARCHAR)") if ranged else ("NULL", "NULL")
    return f"""
SELECT 'orders' AS table_id, '{field}' AS field, '{kind}' AS type, count(*) AS row_count, count(*) - count({value}) AS missing_count,
       round((count(*) - count({value})) / count(*) + 0.0000003, 4) AS missing_fraction, count(DISTINCT {value}) AS cardinality,
       {low} AS min_value, {high} AS max_value FROM o"""


PLAN_ORACLES: dict[str, str] = {
    "contract.load_contract": """
SELECT CAST(o_orderkey AS VARCHAR) AS process_id, CAST(o_custkey AS VARCHAR) AS buyer_id, o_orderpriority AS buyer_name,
       o_orderstatus AS country, CAST(NULL AS VARCHAR) AS category_code, CAST(NULL AS VARCHAR) AS procurement_method,
       round(o_totalprice + 0.0000003, 4) AS tender_value, CAST(NULL AS VARCHAR) AS currency,
       CAST(o_orderdate AS DATE) AS tender_published_date, CAST(NULL AS DATE) AS tender_deadline,
       CAST(NULL AS BIGINT) AS number_of_tenderers
FROM orders""",
    "prepare.redact_text": f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
       {_sql_text(SECRET_ASSIGNMENT)}, '\\1=[redacted]', 'g'), {_sql_text(BEARER_TOKEN)}, 'Bearer [redacted]', 'g'),
       {_sql_text(TOKEN_PREFIX)}, '[redacted]', 'g'), {_sql_text(URL_USERINFO)}, '\\1[redacted]@', 'g') AS text
FROM documents""",
    "prepare.infer_types": """
SELECT event_id AS id, round(value + 0.0000003, 4) AS amount, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS observed_at,
       CASE WHEN user_id % 7 <> 0 THEN event_type END AS name,
       round(CAST(user_id AS DOUBLE) + 0.0000003, 4) AS code
FROM events""",
    "profile.field_metrics": """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate,
                  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, o_orderpriority FROM orders)"""
    + " UNION ALL ".join(
        [
            _metric("o_orderkey", "integer", "o_orderkey", True),
            _metric("o_orderdate", "datetime", "o_orderdate", True),
            _metric("o_totalprice", "float", "o_totalprice", True),
            _metric("o_orderpriority", "text", "o_orderpriority", False),
        ]
    ),
    "profile.value_distribution": """
SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY o_custkey""",
    "profile.duplicate_row_count": """
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) AS d) AS duplicate_rows
FROM lineitem""",
    "profile.temporal_coverage": """
SELECT 'ts' AS field, CAST(min(ts) AS DATE) AS start, CAST(max(ts) AS DATE) AS "end" FROM events""",
    "profile.geographic_coverage": """
SELECT count(*) AS row_count, round(min(c_acctbal / 200.0) + 0.0000003, 4) AS min_latitude,
       round(max(c_acctbal / 200.0) + 0.0000003, 4) AS max_latitude,
       round(min(CAST(c_nationkey * 7 AS DOUBLE)) + 0.0000003, 4) AS min_longitude, round(max(CAST(c_nationkey * 7 AS DOUBLE)) + 0.0000003, 4) AS max_longitude
FROM customer WHERE c_nationkey > 2 AND c_acctbal IS NOT NULL""",
    "profile.copy_differences": """
WITH a AS (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2, 3),
b AS (SELECT o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority,
             count(*) AS n FROM orders GROUP BY 1, 2, 3),
d AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus,
             coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, coalesce(a.n, 0) - coalesce(b.n, 0) AS more
      FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority)
SELECT o_custkey, o_orderstatus, o_orderpriority, CASE WHEN more > 0 THEN 'missing' ELSE 'added' END AS change, abs(more) AS "rows"
FROM d WHERE more <> 0""",
    "match.match_detectors": """
WITH e AS (SELECT avg(CASE WHEN event_type = 'view' THEN 0.0 ELSE 1.0 END) AS amount FROM events),
o AS (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS amount FROM orders),
fits(detector_id, data_fit) AS (
    SELECT 'numeric.zscore_outliers', (1.0 + amount) / 2 FROM e WHERE amount >= 0.75
    UNION ALL SELECT 'numeric.level_shift', (2.0 + amount) / 3 FROM e WHERE amount >= 0.75
    UNION ALL SELECT 'temporal.coverage_gaps', 1.0
    UNION ALL SELECT 'categorical.rare_levels', 1.0
    UNION ALL SELECT 'table.duplicate_rows', 1.0
    UNION ALL SELECT 'table.missingness_clusters', (1.0 + amount) / 2 FROM o WHERE amount >= 0.75
    UNION ALL SELECT 'campaign_finance.maxed_donor_clusters', 1.0
    UNION ALL SELECT 'campaign_finance.new_recipient_single_funder', 1.0
    UNION ALL SELECT 'campaign_finance.structured_gifts', 1.0
),
everyone(detector_id) AS (
    VALUES
        ('numeric.zscore_outliers'), ('numeric.level_shift'), ('temporal.coverage_gaps'),
        ('categorical.rare_levels'), ('table.duplicate_rows'), ('table.missingness_clusters'),
        ('campaign_finance.maxed_donor_clusters'), ('campaign_finance.new_recipient_single_funder'), ('campaign_finance.structured_gifts'),
        ('companies.circular_control'), ('companies.frequent_name_changes'), ('companies.prolific_officer'),
        ('companies.rapid_dissolution'), ('companies.secrecy_jurisdiction_controller'), ('companies.shared_registered_address'),
        ('court.gift_from_litigant_or_counsel'), ('court.judge_holds_party_stock'), ('court.long_pending_cases'),
        ('court.repeat_party_before_judge'), ('court.single_judge_concentration'), ('lobbying.spending_spikes'),
        ('lobbying.missing_spend_filings'), ('lobbying.revolving_door_candidates'), ('lobbying.foreign_filings'),
        ('lobbying.single_client_juggernauts'), ('lobbying.pac_contribution_flow'), ('lobbying.issue_concentration_shifts'),
        ('lobbying.new_registrant_surge'), ('lobbying.shell_pattern_filings'), ('lobbying.fara_gap_narrowed'),
        ('lobbying.revolving_door_committee_match'), ('lobbying.committee_say_vs_pay'), ('lobbying.foreign_clients'),
        ('lobbying.former_official_lobbies_former_institution'), ('lobbying.contact_bursts'), ('parliamentary.absence_outlier'),
        ('parliamentary.group_rebellion_rate'), ('parliamentary.rebellion_rise'), ('parliamentary.group_switch'),
        ('parliamentary.outside_interests_load'), ('procurement.single_bid_competitive'), ('procurement.short_submission_period'),
        ('procurement.non_open_procedure_share'), ('procurement.supplier_share_outlier'), ('procurement.value_growth_after_award')
)
SELECT v.detector_id, round(f.data_fit + 0.0000003, 4) AS data_fit,
       CASE WHEN f.data_fit IS NOT NULL THEN 1 END AS compatible_tables, f.data_fit IS NULL AS blocked
FROM everyone v LEFT JOIN fits f ON f.detector_id = v.detector_id""",
    "leads.fingerprint": """
WITH h AS (
    SELECT CAST('0x' || substr(sha256(
           coalesce(length(CAST(l_orderkey AS VARCHAR)) || ':' || CAST(l_orderkey AS VARCHAR), '~') ||
           coalesce(length(CAST(l_partkey AS VARCHAR)) || ':' || CAST(l_partkey AS VARCHAR), '~') ||
           coalesce(length(CAST(l_suppkey AS VARCHAR)) || ':' || CAST(l_suppkey AS VARCHAR), '~') ||
           coalesce(length(CAST(l_linenumber AS VARCHAR)) || ':' || CAST(l_linenumber AS VARCHAR), '~') ||
           coalesce(length(CAST(l_quantity AS VARCHAR)) || ':' || CAST(l_quantity AS VARCHAR), '~') ||
           coalesce(length(CAST(l_extendedprice AS VARCHAR)) || ':' || CAST(l_extendedprice AS VARCHAR), '~') ||
           coalesce(length(CAST(l_discount AS VARCHAR)) || ':' || CAST(l_discount AS VARCHAR), '~') ||
           coalesce(length(CAST(l_tax AS VARCHAR)) || ':' || CAST(l_tax AS VARCHAR), '~') ||
           coalesce(length(CAST(l_returnflag AS VARCHAR)) || ':' || CAST(l_returnflag AS VARCHAR), '~') ||
           coalesce(length(CAST(l_linestatus AS VARCHAR)) || ':' || CAST(l_linestatus AS VARCHAR), '~') ||
           coalesce(length(CAST(l_shipdate AS VARCHAR)) || ':' || CAST(l_shipdate AS VARCHAR), '~')
           ), 1, 15) AS BIGINT) AS h FROM lineitem
),
parts AS (SELECT count(*) AS "rows", bit_xor(h) AS hash_xor, CAST(sum(h) AS VARCHAR) AS hash_sum FROM h)
SELECT "rows", hash_xor, hash_sum,
       'sha256:' || sha256('l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double,l_discount:double,' ||
           'l_tax:double,l_returnflag:string,l_linestatus:string,l_shipdate:timestamp_ntz|' || "rows" || '|' || hash_xor || '|' || hash_sum) AS fingerprint
FROM parts""",
    "leads.to_leads": f"""
WITH {_FLAGGED}
SELECT 'lead' AS status, {_signal("'numeric.zscore_outliers:events:' || candidate_id")} AS signal_id,
       'numeric.zscore_outliers' AS detector_id, candidate_id, 'statistical' AS category, 'medium' AS severity,
       'Z-score outliers' AS summary, 'outlier' AS row_category
FROM flagged""",
    "leads.with_evidence": f"""
WITH {_FLAGGED}
SELECT {_signal("'numeric.zscore_outliers:t-events:' || candidate_id")} AS signal_id, 'r1' AS run_id, candidate_id,
       'outlier' AS category, 'outlier lead for ' || candidate_id AS statement,
       row_number() OVER (ORDER BY amount DESC, candidate_id) AS rank, 't-events' AS evidence_table,
       'unreviewed' AS review_state
FROM flagged""",
    "leads.write_leads": f"""
WITH {_FLAGGED},
r AS (SELECT *, row_number() OVER (ORDER BY amount DESC, candidate_id) AS rank FROM flagged)
SELECT {_signal("'numeric.zscore_outliers:t-events:' || candidate_id")} AS signal_id, run_id, 'numeric.zscore_outliers' AS detector_id,
       candidate_id, 'outlier' AS category, 'medium' AS severity, 'outlier lead for ' || candidate_id AS statement, rank,
       'unreviewed' AS review_state
FROM r JOIN (VALUES ('r1', 1), ('r2', 2)) AS runs(run_id, step) ON rank % step = 0""",
    "leads.with_lineage": f"""
WITH {_FLAGGED}
SELECT {_signal("'numeric.zscore_outliers:t1,t2:' || candidate_id")} AS signal_id, candidate_id, 't1' AS table_id,
       'statistical' AS category, 2 AS evidence, 'h2' AS second_hash, '3.0' AS z_threshold
FROM flagged""",
    "search.build_search_rows": """
SELECT f AS field, 'text' AS detector_group, count(*) AS "rows",
       count(CASE WHEN f IN ('warnings', 'detector.assumptions', 'detector.false_positives') THEN 1 END) AS empty
FROM documents, (VALUES ('statement'), ('warnings'), ('detector.title'), ('detector.description'), ('detector.assumptions'),
                        ('detector.false_positives'), ('preview.lang'), ('preview.source')) AS fields(f)
GROUP BY f""",
    "search.match_terms": f"""
WITH clean AS (
    SELECT doc_id, source, lang, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
       {_sql_text(SECRET_ASSIGNMENT)}, '\\1=[redacted]', 'g'), {_sql_text(BEARER_TOKEN)}, 'Bearer [redacted]', 'g'),
       {_sql_text(TOKEN_PREFIX)}, '[redacted]', 'g'), {_sql_text(URL_USERINFO)}, '\\1[redacted]@', 'g') AS text
    FROM documents
),
f AS (
    SELECT doc_id, source, lang, 'statement' AS field, lower(text) AS t FROM clean
    UNION ALL SELECT doc_id, source, lang, 'preview.source', source FROM clean
    UNION ALL SELECT doc_id, source, lang, 'preview.lang', lang FROM clean
    UNION ALL SELECT doc_id, source, lang, 'detector.title', 'documents' FROM clean
    UNION ALL SELECT doc_id, source, lang, 'detector.description', 'texts of the source' FROM clean
)
SELECT format('signal-{{:06d}}', doc_id) AS signal_id, source AS run_id, count(*) AS query_score,
       string_agg(field, ',' ORDER BY field) AS matched_on
FROM f
WHERE (lang = 'en' AND contains(t, 'the') AND contains(t, 'src1') AND contains(t, 'source'))
   OR (lang = 'fr' AND contains(t, 'le') AND contains(t, 'un'))
GROUP BY doc_id, source""",
    "search.match_indexed": f"""
WITH clean AS (
    SELECT doc_id, source, lang, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
       {_sql_text(SECRET_ASSIGNMENT)}, '\\1=[redacted]', 'g'), {_sql_text(BEARER_TOKEN)}, 'Bearer [redacted]', 'g'),
       {_sql_text(TOKEN_PREFIX)}, '[redacted]', 'g'), {_sql_text(URL_USERINFO)}, '\\1[redacted]@', 'g') AS text
    FROM documents
),
f AS (
    SELECT doc_id, source, lang, 'statement' AS field, lower(text) AS t FROM clean
    UNION ALL SELECT doc_id, source, lang, 'preview.source', source FROM clean
    UNION ALL SELECT doc_id, source, lang, 'preview.lang', lang FROM clean
    UNION ALL SELECT doc_id, source, lang, 'detector.title', 'documents' FROM clean
    UNION ALL SELECT doc_id, source, lang, 'detector.description', 'texts of the source' FROM clean
),
asked(query, category, terms) AS (
    VALUES ('The SRC1 source', 'en', ['the', 'src1', 'source']), ('thanedble ing', NULL, ['thanedble', 'ing']),
        ('Le un', 'fr', ['le', 'un']), ('no-such-word', NULL, ['no-such-word']), ('É', 'es', ['é'])
)
SELECT format('signal-{{:06d}}', doc_id) AS signal_id, source AS run_id, count(*) AS query_score,
       string_agg(field, ',' ORDER BY field) AS matched_on, query
FROM f JOIN asked ON (category IS NULL OR lang = category) AND len(list_filter(terms, lambda x: contains(t, x))) = len(terms)
GROUP BY doc_id, source, query""",
    "search.page": f"""
WITH clean AS (
    SELECT doc_id, source, lang, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
       {_sql_text(SECRET_ASSIGNMENT)}, '\\1=[redacted]', 'g'), {_sql_text(BEARER_TOKEN)}, 'Bearer [redacted]', 'g'),
       {_sql_text(TOKEN_PREFIX)}, '[redacted]', 'g'), {_sql_text(URL_USERINFO)}, '\\1[redacted]@', 'g')) AS t
    FROM documents
),
scored AS (
    SELECT format('signal-{{:06d}}', doc_id) AS signal_id, source AS run_id,
           CAST(contains(t, 'en') AS INT) + CAST(contains(lang, 'en') AS INT) + 1 AS query_score
    FROM clean
)
SELECT signal_id, run_id, query_score FROM (
    SELECT signal_id, run_id, query_score, row_number() OVER (ORDER BY query_score DESC, signal_id, run_id) AS nth
    FROM scored) AS ranked
WHERE nth BETWEEN 51 AND 100""",
    "replay.recompute": """
WITH c AS (
    SELECT l_linenumber AS k, l_extendedprice AS p, l_tax AS t, l_discount * 100.0 AS sd, l_returnflag = 'R' AS wrong FROM lineitem
),
r AS (
    SELECT CASE k WHEN 1 THEN 'ratio' WHEN 2 THEN 'difference' WHEN 3 THEN 'zscore' WHEN 4 THEN 'count' WHEN 5 THEN 'sum'
                  WHEN 6 THEN 'mean' ELSE 'guess' END AS kind,
           CASE WHEN k = 7 THEN 'unknown calculation kind: guess'
                WHEN k = 1 AND t = 0 THEN 'calculation denominator is zero'
                WHEN k = 3 AND sd = 0 THEN 'calculation standard deviation is zero'
                WHEN wrong THEN 'calculation value does not match operands' ELSE '' END AS reason
    FROM c
)
SELECT kind, reason = '' AS ok, reason, count(*) AS "rows" FROM r GROUP BY kind, reason""",
    "replay.replay": """
SELECT event_type AS run_id, 'd' AS detector_id, 'h' AS detector_hash, 't0,t1,t2' AS table_ids, count(*) AS signal_count,
       count(CASE WHEN user_id % 4 IN (2, 3) THEN 1 END) AS unbound_count
FROM events GROUP BY event_type""",
    "replay.differences": """
SELECT event_type AS run_id, change, count(*) AS "rows" FROM events, (VALUES ('missing'), ('added')) AS c(change)
WHERE event_type = 'view' GROUP BY event_type, change""",
    "replay.draft_findings": """
WITH l AS (
    SELECT CASE WHEN l_linenumber = 7 THEN 'claim-' || CAST(l_orderkey AS VARCHAR)
                ELSE 'claim-' || CAST(l_suppkey AS VARCHAR) END AS claim_id, * FROM lineitem
)
SELECT claim_id, min(l_linenumber) AS rank, 'draft' AS status,
       string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS categories,
       string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS run_ids,
       count(DISTINCT l_orderkey) AS signals, count(DISTINCT l_returnflag) AS "references"
FROM l GROUP BY claim_id""",
    "report.category_counts": """
SELECT label, count(*) AS claims FROM (
    SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN l_orderkey ELSE l_suppkey END AS claim, l_returnflag AS label FROM lineitem) AS c
GROUP BY label""",
    "report.comparable_values": """
SELECT 'claim-' || CAST(o_orderkey AS VARCHAR) AS claim_id, round(o_totalprice + 0.0000003, 4) AS value,
       CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE 1000000000 END AS rank
FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'""",
    "report.detector_counts": """
SELECT event_type AS detector_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS signals FROM events GROUP BY event_type""",
}
PLAN_ORACLES["match.recommend"] = (
    "WITH m AS ("
    + PLAN_ORACLES["match.match_detectors"].replace("round(f.data_fit + 0.0000003, 4) AS data_fit", "f.data_fit AS data_fit")
    + """),
p AS (
    SELECT detector_id, CASE WHEN split_part(detector_id, '.', 1) = 'campaign_finance' THEN 'domain'
                             ELSE split_part(detector_id, '.', 1) END AS detector_group,
           data_fit + CASE WHEN split_part(detector_id, '.', 1) = 'campaign_finance' THEN 0.0 ELSE 1.2 END AS score
    FROM m WHERE NOT blocked
)
SELECT detector_id, detector_group, row_number() OVER (PARTITION BY detector_group ORDER BY score DESC, detector_id) AS rank_in_group,
       round(score + 0.0000003, 4) AS score
FROM p QUALIFY row_number() OVER (ORDER BY score DESC) <= 10"""
)
