"""Registered queries of the front door: files written from the test tables and read back, and detectors by request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.functions.text import BEARER_TOKEN, SECRET_ASSIGNMENT, TOKEN_PREFIX, URL_USERINFO
from leadspark.plans import leads, registry
from leadspark.session import shared_folder
from leadspark.sources import readers
from leadspark.testbed.plan_queries import _sql_text
from leadspark.testbed.queries import Query, read


def _noted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit('said "no", '), "o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, F.lit("\nand left")).otherwise(F.lit("; ok")))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_key"), F.col("o_orderpriority").alias("priority"), note.alias("note")
    )


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "orders-csv")
    _noted_orders(spark, sf_dir).write.option("header", True).option("escape", '"').csv(folder)
    return readers.read_csv(spark, folder)


def _jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "orders-jsonl")
    _noted_orders(spark, sf_dir).write.json(folder)
    return readers.read_jsonl(spark, folder)


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file with an array of customers for every nation."""
    folder = shared_folder(spark, "customers-json")
    customers = read(spark, sf_dir, "customer").select("c_nationkey", F.struct("c_custkey", "c_name").alias("row"))
    arrays = customers.groupBy("c_nationkey").agg(F.to_json(F.collect_list("row")).alias("value"))
    arrays.write.partitionBy("c_nationkey").text(folder)
    return readers.read_json(spark, folder).select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"))


def _parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_parquet(spark, f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag", "l_linenumber").agg(
        F.count("*").alias("rows"), F.min("l_orderkey").alias("least"), F.max("l_shipdate").alias("latest")
    )


def _xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "customers-xml")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_key"), F.concat("c_name", F.lit(" & <sons>")).alias("name"))
    customers.write.format("xml").option("rowTag", "row").option("rootTag", "rows").save(folder)
    return readers.read_xml(spark, folder)


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return readers.union_records(orders, customers, orders.drop("status").filter("id % 5 = 0"))


def _run_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A released detector and the caller's own SQL over one table with mapped columns, in one call."""
    own = "user.large_amounts"
    registry.register_detector(own, "SELECT id AS candidate_id, amount FROM {table} WHERE amount > :least", roles=["id", "amount"])
    try:
        fields = {"id": "event_id", "amount": "value"}
        found = registry.run_detectors(
            read(spark, sf_dir, "events"),
            [
                {"id": "numeric.zscore_outliers", "fields": fields, "parameters": {"z_threshold": 3.0}},
                {"id": own, "fields": fields, "parameters": {"least": 150.0}},
            ],
        )
        return found.select("detector_id", "candidate_id", "category", "severity", "status")
    finally:
        registry.unregister_detector(own)


def _redact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("password"))
    return leads.redact_columns(documents).select("doc_id", "password", F.md5("text").alias("text_md5"))


FRONT_QUERIES: dict[str, Query] = {
    "sources.read_csv": _csv,
    "sources.read_jsonl": _jsonl,
    "sources.read_json": _json,
    "sources.read_parquet": _parquet,
    "sources.read_xml": _xml,
    "sources.union_records": _union,
    "plans.run_detectors": _run_detectors,
    "leads.redact_columns": _redact_columns,
}

_NOTED = """
SELECT CAST(o_orderkey AS VARCHAR) AS order_key, o_orderpriority AS priority,
    'said "no", ' || o_orderstatus || CASE WHEN o_orderkey % 7 = 0 THEN chr(10) || 'and left' ELSE '; ok' END AS note
FROM orders"""

FRONT_ORACLES: dict[str, str] = {
    "sources.read_csv": _NOTED,
    "sources.read_jsonl": _NOTED,
    "sources.read_json": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "sources.read_parquet": """SELECT l_returnflag, l_linenumber, count(*) AS "rows", min(l_orderkey) AS least, max(l_shipdate) AS latest
FROM lineitem GROUP BY ALL""",
    "sources.read_xml": "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || ' & <sons>' AS name FROM customer",
    "sources.union_records": """
SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS name FROM orders
UNION ALL SELECT c_custkey, NULL, c_name FROM customer
UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0""",
    "plans.run_detectors": """
WITH s AS (SELECT sum(value) AS total, sum(value * value) AS squares, count(*) AS n FROM events),
far AS (
    SELECT event_id FROM events, s
    WHERE abs(value - (total - value) / (n - 1))
        >= 3 * sqrt((squares - value * value) / (n - 1) - ((total - value) / (n - 1)) * ((total - value) / (n - 1)))
)
SELECT 'numeric.zscore_outliers' AS detector_id, 'row-' || event_id AS candidate_id, 'statistical' AS category, 'medium' AS severity,
    'lead' AS status FROM far
UNION ALL SELECT 'user.large_amounts', CAST(event_id AS VARCHAR), 'user', 'medium', 'lead' FROM events WHERE value > 150""",
    "leads.redact_columns": f"""
SELECT doc_id, '[redacted]' AS password, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    {_sql_text(SECRET_ASSIGNMENT)}, '\\1=[redacted]', 'g'), {_sql_text(BEARER_TOKEN)}, 'Bearer [redacted]', 'g'),
    {_sql_text(TOKEN_PREFIX)}, '[redacted]', 'g'), {_sql_text(URL_USERINFO)}, '\\1[redacted]@', 'g')) AS text_md5
FROM documents""",
}
