"""Search over n-gram postings: the rows of the plain search, and what the plan reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from leadspark.plans import search, search_index
from leadspark.session import shared_folder


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    syllables = ["ab", "Ba", "ß", "ss", "Éa", "cd ", "x", " ", "😀", "the "]
    data = [
        (f"s{i}", f"r{i % 3}", f"f{j}", "en" if i % 2 else "fr", "".join(rng.choice(syllables) for _ in range(rng.randint(0, 25))))
        for i in range(150)
        for j in range(2)
    ]
    data += [("s0", "r0", "f0", "en", "needle in the hay"), ("s0", "r0", "f0", "en", "needle in the hay"), ("s9", "r9", "f", "en", "z" * 20_000)]
    return spark.createDataFrame(data, "signal_id string, run_id string, field string, category string, text string")


@pytest.fixture(scope="module")
def index(spark, rows):
    return search_index.write_index(rows, shared_folder(spark, "index"))


def plain(df):
    return sorted(tuple(row) for row in df.select("signal_id", "run_id", "query_score", F.array_join("matched_on", ",").alias("m")).collect())


@pytest.mark.parametrize("query", ["needle", "NEEDLE hay", "ab ba", "ssß", "é", "😀", "x", "the ab cd", "zzzz", "nothing-like-it", "", None])
def test_indexed_search_equals_plain_search(rows, index, query):
    assert plain(search_index.match_indexed(index, query)) == plain(search.match_terms(rows, query))
    filtered = search.match_terms(search.filter_leads(rows, category="fr"), query)
    assert plain(search_index.match_indexed(index, query, category="fr")) == plain(filtered)


def test_grams_are_the_runs_of_letters(spark):
    for text in ("", "a", "ab", "abab", "é😀é", "aaaaaa"):
        letters = list(text)
        want = {"".join(letters[i : i + n]) for n in (1, 2, 3) for i in range(len(letters) - n + 1)}
        got = spark.createDataFrame([(text,)], "t string").select(search_index.grams_of(F.col("t"))).first()[0]
        assert len(got) == len(set(got)) and set(got) == want, text


def test_a_search_reads_the_postings_of_its_grams_only(index):
    grams = search_index.query_grams(index, ["needle"])
    assert {gram for gram, _, _ in grams} == {"nee", "eed", "edl", "dle"}
    plan = search_index.match_indexed(index, "needle")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    postings = [line for line in plan.splitlines() if "FileScan parquet" in line and "gram" in line]
    assert postings
    for scan in postings:
        assert re.search(r"PartitionFilters: \[.*bucket", scan) and re.search(r"PushedFilters: \[.*gram", scan)
    texts = [line for line in plan.splitlines() if "FileScan parquet" in line and "folded" in line]
    assert all("dynamicpruning" in scan for scan in texts)


def test_texts_of_one_task_become_many_blocks(spark, rows):
    index = search_index.write_index(rows.coalesce(1), shared_folder(spark, "index"))
    blocks = [row["count"] for row in index.texts.groupBy("block").count().collect()]
    assert len(blocks) > 1 and max(blocks) < sum(blocks) / 2
    assert plain(search_index.match_indexed(index, "ab ba")) == plain(search.match_terms(rows, "ab ba"))


def test_a_repeated_run_replaces_the_index(spark, rows):
    folder = shared_folder(spark, "index")
    search_index.write_index(rows, folder)
    again = search_index.write_index(rows.filter("category = 'fr'"), folder)
    assert plain(search_index.match_indexed(again, "ab")) == plain(search.match_terms(rows.filter("category = 'fr'"), "ab"))
    empty = search_index.write_index(rows.limit(0), shared_folder(spark, "index"))
    assert plain(search_index.match_indexed(empty, "ab")) == []
    assert plain(search_index.match_indexed(empty, None)) == []
