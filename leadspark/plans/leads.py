"""The uniform lead record around detector rows, its redaction, and the lead tables on disk."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadspark.functions.checks import at_least
from leadspark.functions.ordered import with_row_number
from leadspark.functions.relational import top
from leadspark.functions.text import SENSITIVE_COLUMN, redact_text
from leadspark.plans.registry import Detector

REDACTED = "[redacted]"


def is_sensitive(name: str) -> bool:
    return re.search(SENSITIVE_COLUMN, name) is not None


def _redacted(df: DataFrame, policy: str) -> list[Column]:
    columns = []
    for name, kind in df.dtypes:
        value = F.col(f"`{name}`")
        if policy == "redact" and is_sensitive(name):
            value = F.lit(REDACTED)
        elif kind == "string":
            value = redact_text(value)
        columns.append(value.alias(name))
    return columns


def redact_columns(df: DataFrame, policy: str = "redact") -> DataFrame:
    """Withhold sensitive columns by name (policy 'redact') and credential shapes in text."""
    return df.select(*_redacted(df, policy))


def _json(columns: Sequence[Column]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _candidate(rows: DataFrame) -> Column:
    """candidate_id, or else the first column; 'candidate' when neither has a value."""
    names = [name for name in ["candidate_id"] if name in rows.columns] + [rows.columns[0]]
    return F.coalesce(
        *[F.nullif(F.col(f"`{name}`").cast("string"), F.lit("")) for name in names], F.lit("candidate")
    )


def _signal_id(*parts: Column | str) -> Column:
    key = F.concat_ws(":", *[F.lit(part) if isinstance(part, str) else part for part in parts])
    return F.concat(F.lit("signal-"), F.substring(F.sha2(key, 256), 1, 24))


def _provenance(entries: Mapping[str, str]) -> Column:
    pairs = [F.lit(item) for pair in sorted(entries.items()) for item in pair]
    return F.create_map(*pairs).cast("map<string,string>") if pairs else F.lit(None).cast("map<string,string>")


def to_leads(rows: DataFrame, detector: Detector, *, provenance: Mapping[str, str] | None = None) -> DataFrame:
    """One lead per detector row: identity, labels, redacted values as JSON, and provenance.

    The id hashes detector, input (``provenance["input_hash"]``) and candidate.
    Rows with one candidate share an id, as they concern the same thing.
    """
    entries = dict(provenance or {})
    candidate = _candidate(rows)
    return rows.select(
        F.lit("lead").alias("status"),
        _signal_id(detector.id, entries.get("input_hash", ""), candidate).alias("signal_id"),
        F.lit(detector.id).alias("detector_id"),
        F.lit(detector.version).alias("detector_version"),
        candidate.alias("candidate_id"),
        F.lit(detector.category).alias("category"),
        F.lit(detector.severity).alias("severity"),
        F.lit(detector.title).alias("summary"),
        _json(_redacted(rows, "redact" if detector.redact else "none")).alias("values"),
        _provenance(entries).alias("provenance"),
    )


def _evidence(tables: Mapping[str, Mapping[str, str]], candidate: Column) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(source["source_id"]).alias("source_id"),
                F.lit(table_id).alias("table_id"),
                candidate.alias("candidate_id"),
            )
            for table_id, source in tables.items()
        ]
    )


def leads_with_evidence(
    rows: DataFrame,
    detector: Detector,
    *,
    table_id: str,
    source_id: str,
    source_hash: str,
    run_id: str,
    detector_hash: str = "",
    order: Sequence[Column] | None = None,
    max_output_rows: int | None = None,
    run_date: str | None = None,
) -> DataFrame:
    """Leads of one run over one prepared table, ranked, with a statement and evidence references.

    ``order`` is the detector's own order; without it leads rank by candidate.
    All rows are ranked, in ranges of the order; ``max_output_rows`` keeps the first ones only.
    """
    if max_output_rows is not None:
        at_least("max_output_rows", max_output_rows, 1)
    candidate = _candidate(rows)
    order = list(order or [candidate])
    rows = with_row_number(top(rows, order, max_output_rows), order, "_rank")
    category = F.col("category") if "category" in rows.columns else F.lit(detector.category)
    severity = F.col("severity") if "severity" in rows.columns else F.lit(detector.severity)
    own = rows.drop("_rank")
    shown = [column for column, name in zip(_redacted(own, "none"), own.columns, strict=True) if not is_sensitive(name)]
    reported_on = F.current_date() if run_date is None else F.lit(run_date).cast("date")
    return rows.select(
        F.lit("lead").alias("status"),
        _signal_id(detector.id, table_id, candidate).alias("signal_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(detector.id).alias("detector_id"),
        F.lit(detector_hash).alias("detector_hash"),
        F.lit(table_id).alias("table_id"),
        F.lit(source_id).alias("source_id"),
        F.lit(source_hash).alias("source_hash"),
        candidate.alias("candidate_id"),
        category.alias("category"),
        severity.alias("severity"),
        redact_text(F.concat(category, F.lit(" lead for "), candidate)).alias("statement"),
        F.col("_rank").alias("rank"),
        _evidence({table_id: {"source_id": source_id}}, candidate).alias("evidence_refs"),
        _json(shown).alias("preview"),
        F.lit(True).alias("redacted"),
        reported_on.alias("run_date"),
        F.lit("unreviewed").alias("review_state"),
    )


def leads_with_lineage(
    rows: DataFrame,
    detector: Detector,
    tables: Mapping[str, Mapping[str, str]],
    *,
    run_id: str,
    parameters: Mapping[str, object] | None = None,
    detector_hash: str = "",
) -> DataFrame:
    """Leads of one run over several tables, with the lineage of every table.

    ``tables`` maps table ids to their ``source_id`` and ``source_hash``, in the
    order the detector reads them.
    """
    candidate = _candidate(rows)
    executed_at = F.current_timestamp()
    sources = F.create_map(
        *[
            item
            for table_id, source in tables.items()
            for item in (
                F.lit(table_id),
                F.struct(F.lit(source["source_id"]).alias("source_id"), F.lit(source["source_hash"]).alias("source_hash")),
            )
        ]
    )
    first_hash = next(iter(tables.values()))["source_hash"]
    observed = F.col("observed_at").cast("string") if "observed_at" in rows.columns else executed_at.cast("string")
    return rows.select(
        F.lit("lead").alias("status"),
        _signal_id(detector.id, ",".join(tables), candidate).alias("signal_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(detector.id).alias("detector_id"),
        F.lit(detector.version).alias("detector_version"),
        F.lit(detector_hash).alias("detector_hash"),
        F.lit(next(iter(tables))).alias("table_id"),
        F.lit(first_hash).alias("source_hash"),
        candidate.alias("candidate_id"),
        F.lit(detector.category).alias("category"),
        F.lit(detector.severity).alias("severity"),
        F.lit(detector.title).alias("summary"),
        observed.alias("observed_at"),
        executed_at.alias("executed_at"),
        _json(_redacted(rows, "redact" if detector.redact else "none")).alias("values"),
        _evidence(tables, candidate).alias("evidence_refs"),
        F.array().cast("array<string>").alias("warnings"),
        F.struct(
            F.lit(detector.family).alias("source_family"),
            F.array(*[F.lit(table_id) for table_id in tables]).alias("table_ids"),
            F.array(*[F.lit(source["source_hash"]) for source in tables.values()]).alias("source_hashes"),
            sources.alias("table_sources"),
            _provenance({key: str(value) for key, value in (parameters or {}).items()}).alias("parameters"),
        ).alias("provenance"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Content fingerprint of a table that does not depend on row order: one row, one pass.

    A row is the text of its values, each after its length (NULL is ``~``). The
    first 60 bits of the rows' SHA-256 are combined by xor and by an exact sum,
    so repeated rows count.
    """
    texts = [F.col(f"`{name}`").cast("string") for name in df.columns]
    row = F.concat(*[F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("~")) for text in texts])
    bits = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("long")
    parts = df.select(bits.alias("h")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
    )
    text = F.concat_ws(
        "|", F.lit(",".join(f"{name}:{kind}" for name, kind in df.dtypes)), "rows", "hash_xor", "hash_sum"
    )
    return parts.select("rows", "hash_xor", "hash_sum", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("fingerprint"))


RUN_FOLDERS = ("detector_id", "run_id")


def write_leads(leads: DataFrame, path: str, *, format: str = "parquet") -> None:
    """Write leads to a lead table, one folder per detector and run.

    What is written replaces the folders of its own detectors and runs and no others, so a
    task, a job or a whole run can be repeated and every lead is there once; readers
    see a folder's old rows or its new ones. A repeated run that finds nothing has no folder to
    replace; remove the old one by hand. Parquet is written with zstd; JSON gives one record per line.
    """
    missing = [name for name in RUN_FOLDERS if name not in leads.columns]
    if missing:
        raise ValueError(f"leads without {missing} cannot be told apart by run")
    writer = leads.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_FOLDERS)
    if format == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif format == "json":
        writer.json(path)
    else:
        raise ValueError("leads are written as parquet or json")


def read_leads(spark: SparkSession, path: str, schema: StructType, *, format: str = "parquet") -> DataFrame:
    """The leads of all runs in a lead table, with the columns of ``schema`` (those that were written)."""
    if format not in ("parquet", "json"):
        raise ValueError("leads are read as parquet or json")
    return spark.read.schema(schema).format(format).load(path).select(*schema.names)
