"""N-gram postings of the search rows: a query reads the postings of its rarest grams, then checks whole texts.

Three tables in one folder. ``texts`` has the search rows with their folded text and a
number, in blocks. ``postings`` has one row for each gram of one, two or three
letters and each text it is in; ``grams`` has how many texts that are. Postings
and grams are partitioned by a hash of the gram, so a query opens only the folders of
its grams; texts are partitioned by block, so that only blocks with a possible text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadspark.plans.search import filter_leads, folded, match_terms, matched_leads, query_terms

GRAM = 3
BUCKETS = 64
# Files of one bucket: a gram that nearly every text has is spread over them.
SLICES = 4
# Grams that take part in a search: the rarest, and further ones that are at most this many times as frequent.
MOST_GRAMS, WORTH = 6, 16
# Numbers of one block of texts (monotonically increasing numbers have the writing task above bit 33).
_TASK_BITS = 33


@dataclass(frozen=True)
class SearchIndex:
    texts: DataFrame
    postings: DataFrame
    grams: DataFrame


def grams_of(text: Column, longest: int = GRAM, shortest: int = 1) -> Column:
    """The distinct runs of ``shortest`` to ``longest`` letters of a text."""

    def found(letters: Column) -> Column:
        def cut(runs: Column, start: int, length: int) -> Column:
            return F.slice(runs, F.lit(start), F.greatest(F.size(letters) - length + 1, F.lit(0)))

        def grown(runs: Column, length: int, shorter: list[Column]) -> Column:
            """Runs of one letter more are those of ``length``, each with the letter that follows."""
            made = [*shorter, runs] if length >= shortest else shorter
            if length == longest:
                return F.array_distinct(F.concat(*made))
            more = F.zip_with(cut(runs, 1, length + 1), cut(letters, length + 1, length + 1), lambda run, letter: F.concat(run, letter))
            return F.transform(F.array(more), lambda longer: grown(longer, length + 1, made))[0]

        return grown(letters, 1, [])

    # The letters are split off once, not once for each place.
    made = F.transform(F.array(F.split(text, "")), found)[0]
    return F.when(text == "", F.array().cast("array<string>")).otherwise(made)


def _bucket(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(search_rows: DataFrame, folder: str) -> SearchIndex:
    """Write the index of ``search_rows`` (see ``build_search_rows``) and open it.

    The numbers of the texts are fixed by writing them first. A run that is repeated
    replaces the folder's tables as a whole. Rows are dealt out first: a file that
    comes as one block of rows would otherwise be one block of texts, and its grams one task.
    """
    spark = search_rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    numbered = search_rows.repartition(parts).withColumn("folded", folded(F.col("text"))).withColumn("row_id", F.monotonically_increasing_id())
    block = F.shiftright("row_id", _TASK_BITS).cast("int")
    numbered = numbered.withColumn("block", block)
    stored = numbered.schema
    numbered.write.mode("overwrite").partitionBy("block").parquet(f"{folder}/texts")
    texts = spark.read.schema(stored).parquet(f"{folder}/texts")
    rows = texts.select("block", "row_id", F.explode(grams_of(F.col("folded"))).alias("gram")).withColumn("bucket", _bucket("gram"))
    dealt = rows.repartition("bucket", F.pmod("row_id", F.lit(SLICES))).sortWithinPartitions("bucket", "gram", "row_id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    postings = spark.read.schema(_POSTINGS).parquet(f"{folder}/postings")
    counted = postings.groupBy("bucket", "gram").agg(F.count("*").alias("texts"))
    counted.repartition("bucket").sortWithinPartitions("gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/grams")
    return open_index(spark, folder, stored)


# Fixed layout of the two tables that only the index knows.
_POSTINGS = "block int, row_id bigint, gram string, bucket int"
_GRAMS = "gram string, texts bigint, bucket int"


def open_index(spark: SparkSession, folder: str, texts: StructType | None = None) -> SearchIndex:
    """The tables of a folder; ``texts`` is the schema of its texts, which an empty table does not tell."""
    reader = spark.read if texts is None else spark.read.schema(texts)
    return SearchIndex(
        reader.parquet(f"{folder}/texts"),
        spark.read.schema(_POSTINGS).parquet(f"{folder}/postings"),
        spark.read.schema(_GRAMS).parquet(f"{folder}/grams"),
    )


def query_grams(index: SearchIndex, terms: list[str]) -> list[tuple[str, int, int]] | None:
    """(gram, bucket, texts) of the terms' longest grams, rarest first; None if no text has one of them."""
    spark = index.texts.sparkSession
    asked = spark.createDataFrame([(term,) for term in terms], "term string").withColumn("term", folded(F.col("term")))
    length = F.least(F.length("term"), F.lit(GRAM))
    grams = F.filter(grams_of(F.col("term")), lambda gram: F.length(gram) == length)
    # Not more rows than the query has letters.
    wanted = [row.gram for row in asked.select(F.explode(grams).alias("gram")).distinct().collect()]
    if not wanted:
        return []
    named = spark.createDataFrame([(gram,) for gram in wanted], "gram string").withColumn("bucket", _bucket("gram")).collect()
    buckets = sorted({row.bucket for row in named})
    known = index.grams.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted)).collect()
    if len(known) < len(wanted):
        return None
    return sorted(((row.gram, row.bucket, row.texts) for row in known), key=lambda row: (row[2], row[0]))


def match_indexed(index: SearchIndex, query: str | None, **filters: str) -> DataFrame:
    """The rows of :func:`leadspark.plans.search.match_terms`, by way of the postings.

    A text with all terms is in the postings of all their grams. The rarest grams
    choose the possible texts, and the terms are looked for in these only. Terms of one or two letters
    use grams of that length. ``filters`` as in ``filter_leads``.
    """
    terms = query_terms(query)
    texts = filter_leads(index.texts, **filters)
    if not terms:
        return match_terms(texts, query)
    grams = query_grams(index, terms)
    if not grams:
        possible = texts.limit(0) if grams is None else texts
    else:
        rarest = max(grams[0][2], 1)
        chosen = [row for row in grams[:MOST_GRAMS] if row[2] <= WORTH * rarest]
        hits = index.postings.filter(
            F.col("bucket").isin(sorted({bucket for _, bucket, _ in chosen})) & F.col("gram").isin([gram for gram, _, _ in chosen])
        )
        met = hits.groupBy("block", "row_id").agg(F.count("*").alias("_grams")).filter(F.col("_grams") == len(chosen))
        possible = texts.join(met.select("block", "row_id"), ["block", "row_id"], "left_semi")
    for term in terms:
        possible = possible.filter(F.col("folded").contains(folded(F.lit(term))))
    return matched_leads(possible)
