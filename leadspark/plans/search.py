"""Search over produced leads: structured filters, terms, and keyset pages."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions.text import redact_text
from leadspark.plans.registry import Detector

# Filter name -> column of the lead table.
FILTERS = {
    "detector_id": "detector_id",
    "group": "detector_group",
    "category": "category",
    "severity": "severity",
    "source_id": "source_id",
    "table_id": "table_id",
    "run_id": "run_id",
    "date": "run_date",
    "review_state": "review_state",
}
MAX_PAGE = 100
# Letters that fold to more than one letter or to another than their lower case.
FOLDS = {"ß": "ss", "ſ": "s", "ς": "σ", "ŉ": "ʼn", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


class SearchError(ValueError):
    """The query, a filter or a cursor is not valid."""


def detector_rows(spark, detectors: Mapping[str, Detector]) -> DataFrame:
    """Searchable text of the detectors, one row each."""
    return spark.createDataFrame(
        [
            (
                item.id,
                item.group,
                item.title,
                item.description,
                " ".join(item.assumptions),
                " ".join(item.false_positives),
            )
            for item in detectors.values()
        ],
        "detector_id string, detector_group string, title string, description string, "
        "assumptions string, false_positives string",
    )


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Fail if a key occurs twice; looks for one repeated key only."""
    repeated = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if repeated:
        raise SearchError(f"({', '.join(keys)}) is not unique: {repeated[0].asDict()}")


def build_search_rows(leads: DataFrame, detectors: DataFrame) -> DataFrame:
    """Long-form search table: one row per lead and text field.

    Fields are the statement, the warnings, the detector's texts and every leaf
    of the preview (``preview.<name>``). Write it once, partitioned by
    detector_id, and search it many times.
    """
    warnings = F.array_join("warnings", " ") if "warnings" in leads.columns else F.lit("")
    # Preview leaves: lists are joined by blanks, nested records keep their JSON text.
    preview = F.map_entries(F.from_json("preview", "map<string,string>"))
    leaf = F.transform(
        F.coalesce(preview, F.array().cast("array<struct<key:string,value:string>>")),
        lambda entry: F.struct(
            F.concat(F.lit("preview."), entry["key"]).alias("field"),
            F.coalesce(
                F.array_join(F.from_json(entry["value"], "array<string>"), " "), entry["value"], F.lit("")
            ).alias("text"),
        ),
    )

    def named(field: str, text) -> object:
        return F.struct(F.lit(field).alias("field"), F.coalesce(text, F.lit("")).alias("text"))

    fixed = F.array(
        named("statement", F.col("statement")),
        named("warnings", warnings),
        *[named(f"detector.{name}", F.col(name)) for name in ("title", "description", "assumptions", "false_positives")],
    )
    joined = leads.join(detectors, "detector_id")
    wanted = dict.fromkeys(["signal_id", "run_id", *FILTERS.values()])
    kept = [name for name in wanted if name in joined.columns]
    return joined.select(*kept, F.explode(F.concat(fixed, leaf)).alias("_f")).select(
        *kept, F.col("_f.field").alias("field"), redact_text(F.col("_f.text")).alias("text")
    )


def filter_leads(df: DataFrame, **filters: str) -> DataFrame:
    """Equality filters; those on partition columns prune folders."""
    for name, value in sorted(filters.items()):
        if name not in FILTERS:
            raise SearchError(f"unknown search filter: {name}")
        if not isinstance(value, str) or not value:
            raise SearchError(f"invalid search filter: {name}")
        if name == "date":
            try:
                date.fromisoformat(value)
            except ValueError as error:
                raise SearchError("invalid search date") from error
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
                raise SearchError("invalid search date")
        df = df.filter(F.col(FILTERS[name]).cast("string") == value)
    return df


def query_terms(query: str | None) -> list[str]:
    """The terms of a query: what stands between blanks."""
    if query is None:
        return []
    if not isinstance(query, str):
        raise SearchError("search query must be text")
    return query.split()


def folded(text: Column) -> Column:
    """Lower case in which ``ß`` and ``ss`` (and the other folds) are equal; used for texts and queries alike."""
    text = F.lower(text)
    for letter, fold in FOLDS.items():
        text = F.replace(text, F.lit(letter), F.lit(fold))
    return text


def match_terms(search_rows: DataFrame, query: str | None) -> DataFrame:
    """Leads with a field that holds all terms; the score counts such fields.

    Without terms every lead is kept with score 0.
    """
    terms = query_terms(query)
    keys = ["signal_id", "run_id"]
    if not terms:
        return search_rows.select(*keys).distinct().select(
            *keys, F.lit(0).cast("long").alias("query_score"), F.array().cast("array<string>").alias("matched_on")
        )
    matches = search_rows
    for term in terms:
        matches = matches.filter(folded(F.col("text")).contains(folded(F.lit(term))))
    return matched_leads(matches)


def matched_leads(matches: DataFrame) -> DataFrame:
    """One row per lead of the search rows that match; the score counts them."""
    # A lead has as many fields as its detector has columns, so the list stays short.
    return matches.groupBy("signal_id", "run_id").agg(
        F.count(F.lit(1)).alias("query_score"), F.array_sort(F.collect_list("field")).alias("matched_on")
    )


def _binding(query: str | None, filters: Mapping[str, str]) -> str:
    text = json.dumps([" ".join(query_terms(query)).casefold(), sorted(filters.items())])
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode_cursor(row, query: str | None, filters: Mapping[str, str]) -> str:
    """Cursor after a result row; it only continues the same query and filters."""
    key = [row["query_score"], row["signal_id"], row["run_id"], _binding(query, filters)]
    return base64.urlsafe_b64encode(json.dumps(key).encode("utf-8")).decode("ascii")


def _decode_cursor(cursor: str, query: str | None, filters: Mapping[str, str]) -> tuple[int, str, str]:
    try:
        score, signal_id, run_id, binding = json.loads(base64.urlsafe_b64decode(cursor.encode("ascii")))
    except ValueError as error:
        raise SearchError("invalid search cursor") from error
    if binding != _binding(query, filters):
        raise SearchError("search cursor belongs to another query")
    return int(score), str(signal_id), str(run_id)


def page(
    matches: DataFrame,
    *,
    limit: int = 20,
    cursor: str | None = None,
    query: str | None = None,
    filters: Mapping[str, str] | None = None,
) -> DataFrame:
    """One page in the order (score descending, signal_id, run_id), after the cursor's row."""
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_PAGE:
        raise SearchError(f"search limit must be between 1 and {MAX_PAGE}")
    if cursor is not None:
        score, signal_id, run_id = _decode_cursor(cursor, query, filters or {})
        later = (F.col("signal_id") > signal_id) | ((F.col("signal_id") == signal_id) & (F.col("run_id") > run_id))
        matches = matches.filter(
            (F.col("query_score") < score) | ((F.col("query_score") == score) & later)
        )
    return matches.orderBy(F.col("query_score").desc(), "signal_id", "run_id").limit(limit)


def search(
    search_rows: DataFrame,
    query: str | None = None,
    *,
    filters: Mapping[str, str] | None = None,
    limit: int = 20,
    cursor: str | None = None,
) -> DataFrame:
    """Filter, match and page in one plan."""
    chosen = dict(filters or {})
    return page(
        match_terms(filter_leads(search_rows, **chosen), query),
        limit=limit,
        cursor=cursor,
        query=query,
        filters=chosen,
    )
