"""How five quality filters interact: what each removes in every order, alone, and on average.

Each document gets the letters of the filters it fails. Four look at the text
alone. The fifth, exact repeats, has a prepass: a counting Bloom filter over all
texts, counted partition by partition and merged. A text with a cell that nobody
else counts is unique for certain; only the others are shuffled, as whole texts,
to find the smallest id of each. What filters remove in any order follows from
the number of documents with each set of letters, so orders are never applied to
documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import WORD_BREAK

LETTERS = "ABCDE"
# Cells for each document, and cells each text counts in: one unique text in 170 passes by chance.
CELLS_PER_TEXT, PROBES = 16, 3
# Bits of one row of the sketch, as Spark's bitmap functions have them.
BITMAP_BITS = 32_768
# Up to this many rows of 4 KB the sketch is broadcast (64 MB, 33 million documents); beyond, it is joined by shuffle.
BROADCAST_BITMAPS = 16_384


def _block(blocks: int) -> Column:
    return F.pmod(F.col("hash"), F.lit(blocks))


def _places() -> list[Column]:
    """The positions of a text's cells inside its block (from 0)."""
    bits = F.xxhash64("hash")
    return [F.shiftrightunsigned(bits, 15 * i).bitwiseAND(F.lit(BITMAP_BITS - 1)) for i in range(PROBES)]


def repeated_cells(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, bitmap): the cells that two or more of the ``hash`` values count in.

    Tasks count their own cells before the shuffle, so a text with any number of
    copies sends one count for each of its cells. A text whose own cells fall
    together counts once.
    """
    own = hashes.select(_block(blocks).alias("block"), F.explode(F.array_distinct(F.array(*_places()))).alias("place"))
    counted = own.groupBy("block", "place").agg(F.count("*").alias("times")).where("times > 1")
    # Bitmap positions of one block: bit (place) of a bitmap of 32,768.
    return counted.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bitmap"))


def _is_set(place: Column) -> Column:
    byte = F.conv(F.hex(F.substr("bitmap", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1


def possible_repeats(texts: DataFrame, blocks: int) -> DataFrame:
    """``texts`` (id, text, hash) without those whose text is unique for certain."""
    sketch = repeated_cells(texts.select("hash"), blocks)
    if blocks <= BROADCAST_BITMAPS:
        sketch = F.broadcast(sketch)
    met = texts.withColumn("block", _block(blocks)).join(sketch, "block")
    for place in _places():
        met = met.where(_is_set(place))
    return met.select(*texts.columns)


def later_copies(texts: DataFrame, blocks: int) -> DataFrame:
    """(id, hash) of the ``texts`` whose text a smaller id has too."""
    repeats = possible_repeats(texts, blocks)
    # Copies collapse to one row a task before whole texts are shuffled.
    smallest = repeats.groupBy("text").agg(F.min("id").alias("first")).select("first", F.xxhash64("text").alias("same"))
    asked = repeats.select("id", "hash").where("id IS NOT NULL").distinct()
    return asked.join(smallest, (F.col("id") == F.col("first")) & (F.col("hash") == F.col("same")), "left_anti")


def text_failures(text: Column) -> Column:
    """Letters of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, WORD_BREAK), "")
    total = F.size(words)
    fails = {
        "A": total < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * total,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return F.concat(*[F.when(fail, letter).otherwise("") for letter, fail in fails.items()])


def failed_filters(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """(id, part, failed): the letters of the filters that each document fails, in the order of the alphabet.

    A: under 100 words (parted by ASCII white space); B: under 80 % distinct
    words; C: over 10 % capitals A-Z; D: a character of ``#$%&*|``; E: a document
    with a smaller id has the same text. One row per row of ``docs``. NULL texts
    and parts are empty. Rows that repeat id and text are no repeats of each
    other; a NULL id is neither smaller nor larger than another, so it never fails
    E. Other columns are not read; an empty table gives no rows.
    """
    blocks = -(-docs.count() * CELLS_PER_TEXT // BITMAP_BITS) or 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    flagged = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        F.xxhash64(text).alias("hash"),
        text_failures(text).alias("failed"),
    )
    later = later_copies(texts, blocks).withColumn("last_letter", F.lit("E"))
    met = flagged.join(later, ["id", "hash"], "left")
    return met.select("id", "part", F.concat("failed", F.coalesce("last_letter", F.lit(""))).alias("failed"))


def filter_audit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """What each filter does in each order of the five, by part.

    ``docs`` as in :func:`failed_filters`; ``labels`` (id, quality, toxic) may
    lack or repeat ids: a document is good (toxic) if any of its labels says so.
    Returns part, filter_order, step (1 to 5; its filter is that letter) and
    counts: kept after the step, removed by it, redundant (failing, but removed
    before), unique_fails (failing this filter only), good_lost and toxic_lost
    among the removed, and shapley (what the filter removes, summed over all
    orders). 600 rows for every part, zeros included; none without documents.
    """
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    said = said.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    failed = failed_filters(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    marked = failed.join(said, "id", "left").select(
        "part", "failed", *[F.coalesce(name, F.lit(False)).alias(name) for name in ("good", "toxic")]
    )
    # At most 32 sets of letters and four kinds of label for each part: the orders meet only these counts.
    counts = marked.groupBy("part", "failed", "good", "toxic").agg(F.count("*").alias("n"))
    orders = F.array(*[F.lit("".join(order)) for order in permutations(LETTERS)])
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    earlier = F.substr("filter_order", F.lit(1), F.col("step") - 1)
    fails = F.contains(F.col("failed"), letter)
    alive = F.length(F.call_function("translate", F.col("failed"), earlier, F.lit(""))) == F.length("failed")

    def total(condition: Column, weight: Column | None = None) -> Column:
        return F.sum(F.when(condition, F.col("n") if weight is None else weight).otherwise(0)).cast("long")

    # A document is removed by each of the filters it fails in an equal share of the 120 orders.
    share = F.expr(f"n * {len(list(permutations(LETTERS)))} DIV length(failed)")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(alive & ~fails).alias("kept"),
        total(alive & fails).alias("removed"),
        total(~alive & fails).alias("redundant"),
        total(F.col("failed") == letter).alias("unique_fails"),
        total(alive & fails & F.col("good")).alias("good_lost"),
        total(alive & fails & F.col("toxic")).alias("toxic_lost"),
        total(fails, F.when(fails, share)).alias("shapley"),
    )
