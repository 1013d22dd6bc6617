"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled.

A text is cut into paragraphs, a paragraph is a 60-bit digest, and a fingerprint
is a table of cells. Every digest counts in three cells; a cell holds how many
digests it has, the XOR of them and the XOR of their checks. Subtracting the
cells of two texts cancels what both have. A cell left with one digest gives it
away; taking it out of its other cells frees the next ("peeling").

A table consists of blocks of 24 cells, dealt by the low bits of the digest, so
that the work grows in proportion to the paragraphs. A block that does not peel
is retried with twice the cells: its digests are split over two blocks by the
next bit, and only these are built again.

Column functions alone; all steps are integer arithmetic that any SQL engine has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.session import cut_lineage

# A block: three rows of eight cells. A digest has one cell in each row, by three bits each from bit 40 on.
ROWS, ROW_CELLS, ROW_BITS, FIRST_BIT = 3, 8, 3, 40
# A fingerprint has as many blocks as leave twelve digests for each on average.
PER_BLOCK = 12
# Bits that deal digests to blocks. A retry uses the next one.
SPLITS = 40
ROUNDS = 12
# Paragraphs end with a line, or with a sentence whose length is a multiple of this.
SENTENCE_STEP = 4
SENTENCES = r"([^.!?\n]*[.!?\n]+|[^.!?\n]+)"
_DIGITS = 15  # hexadecimal, of an MD5
_PRIME = 2_147_483_647
_FOUND = "array<struct<c:int,k:bigint>>"
_PAIRS = "array<struct<a:array<bigint>,b:array<bigint>>>"


def _with(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with ``value`` evaluated once."""
    return F.transform(F.array(value), of)[0]


def paragraph_digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, in their order. NULL and '' have none.

    Where a paragraph ends depends on its last sentence alone, so an edit moves
    no other end.
    """
    sentences = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCES), F.lit(1))
    ends = lambda s: F.contains(s, F.lit("\n")) | (F.length(s) % SENTENCE_STEP == 0)
    marked = F.transform(sentences, lambda s: F.when(ends(s), F.concat(s, F.lit("\0"))).otherwise(s))
    paragraphs = F.array_remove(F.split(F.array_join(marked, ""), "\0"), "")
    return F.array_distinct(F.transform(paragraphs, lambda p: F.conv(F.left(F.md5(p), F.lit(_DIGITS)), 16, 10).cast("bigint")))


def _bit(key: Column, place: Column) -> Column:
    return F.call_function("shiftright", key, place).bitwiseAND(F.lit(1))


def _halves(keys: Column, place: Column) -> list[Column]:
    return [F.filter(keys, lambda k: _bit(k, place) == 0), F.filter(keys, lambda k: _bit(k, place) == 1)]


def split_level(digests: Column) -> Column:
    """How many bits deal the digests of a text to its blocks."""
    blocks = F.ceil(F.size(digests) / PER_BLOCK)
    return F.when(blocks <= 1, 0).otherwise(F.length(F.bin(blocks - 1)))


def _places(level: Column) -> Column:
    return F.slice(F.sequence(F.lit(0), F.lit(SPLITS - 1)), F.lit(1), level)


def _blocks(keys: Column, level: Column) -> Column:
    def split(blocks, place):
        return F.flatten(F.transform(blocks, lambda block: F.array(*_halves(block, place))))

    return F.aggregate(_places(level), F.array(keys), split)


def _check(key: Column) -> Column:
    """A number that the XOR of several digests has only by chance (2^-31)."""
    rest = key % _PRIME
    return (rest * rest + F.shiftright(key, 31) * 7) % _PRIME


def _in_cell(key: Column, cell: Column) -> Column:
    start = FIRST_BIT + ROW_BITS * F.floor(cell / ROW_CELLS).cast("int")
    return F.call_function("shiftright", key, start).bitwiseAND(F.lit(ROW_CELLS - 1)) == cell % ROW_CELLS


def _changed(cell: Column, count: Column, key: Column) -> Column:
    return F.struct(
        (cell["c"] + count).cast("int").alias("c"),
        cell["k"].bitwiseXOR(key).alias("k"),
        cell["h"].bitwiseXOR(_check(key)).alias("h"),
    )


def sketch(keys: Column) -> Column:
    """The 24 cells of a block."""
    empty = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("h"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(ROWS * ROW_CELLS - 1)),
        lambda cell: F.aggregate(
            F.filter(keys, lambda k: _in_cell(k, cell)), empty, lambda held, k: _changed(held, F.lit(1), k)
        ),
    )


def _subtracted(one: Column, other: Column) -> Column:
    return F.zip_with(
        one,
        other,
        lambda x, y: F.struct(
            (x["c"] - y["c"]).cast("int").alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")
        ),
    )


def _peeled(cells: Column) -> Column:
    """(cells, found): what is left of the cells, and the digests taken out with the side they are on (1 or -1)."""

    def round_(state, _):
        alone = F.filter(state["cells"], lambda x: (F.abs(x["c"]) == 1) & (_check(x["k"]) == x["h"]))
        given = F.array_distinct(F.transform(alone, lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"))))

        def without(pure):
            left = F.transform(
                state["cells"],
                lambda cell, i: F.aggregate(
                    F.filter(pure, lambda p: _in_cell(p["k"], i)), cell, lambda held, p: _changed(held, -p["c"], p["k"])
                ),
            )
            return F.when(F.size(pure) == 0, state).otherwise(
                F.struct(left.alias("cells"), F.concat(state["found"], pure).alias("found"))
            )

        return _with(given, without)

    start = F.struct(cells.alias("cells"), F.array().cast(_FOUND).alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)


def differing_digests(one: Column, other: Column) -> Column:
    """The digests that one of two texts has alone, with the side (1: ``one``, -1: ``other``).

    Both are sketched with as many blocks as the text with more paragraphs has.
    """
    level = F.greatest(split_level(one), split_level(other))
    start = F.struct(
        F.array().cast(_FOUND).alias("found"),
        F.zip_with(_blocks(one, level), _blocks(other, level), lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("open"),
    )

    def tried(state, place):
        outcomes = F.transform(
            state["open"],
            lambda pair: F.struct(pair.alias("pair"), _peeled(_subtracted(sketch(pair["a"]), sketch(pair["b"]))).alias("peel")),
        )

        def sorted_out(done):
            clear = lambda o: F.forall(o["peel"]["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0))
            found = F.flatten(F.transform(F.filter(done, clear), lambda o: o["peel"]["found"]))

            def larger(o):
                sides = zip(_halves(o["pair"]["a"], place), _halves(o["pair"]["b"], place), strict=True)
                return F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in sides])

            again = F.flatten(F.transform(F.filter(done, lambda o: ~clear(o)), larger))
            return F.struct(F.concat(state["found"], found).alias("found"), again.cast(_PAIRS).alias("open"))

        return F.when(F.size(state["open"]) == 0, state).otherwise(_with(outcomes, sorted_out))

    places = F.slice(F.sequence(F.lit(0), F.lit(SPLITS - 1)), level + 1, F.lit(SPLITS))
    return F.aggregate(places, start, tried, lambda state: state["found"])


def likeness(one: Column, other: Column) -> Column:
    """The share of the paragraphs of two texts that both have (1.0 for two texts without any)."""
    return _with(
        F.size(differing_digests(one, other)),
        lambda apart: _with(
            (F.size(one) + F.size(other) - apart) / 2,
            lambda both: F.when(both + apart == 0, F.lit(1.0)).otherwise(both / (both + apart)),
        ),
    )


def fingerprint(digests: Column) -> Column:
    """The sketch as text: count, digests and checks of each cell, '' for an empty one; blocks parted by a semicolon."""

    def written(cell):
        numbers = F.concat_ws(":", cell["c"].cast("string"), F.lower(F.hex(cell["k"])), F.lower(F.hex(cell["h"])))
        return F.when(cell["c"] == 0, "").otherwise(numbers)

    return F.array_join(
        F.transform(_blocks(digests, split_level(digests)), lambda block: F.array_join(F.transform(sketch(block), written), ",")), ";"
    )


def with_next(docs: DataFrame, key: Column, value: Column) -> DataFrame:
    """``docs`` with ``_next``: ``value`` of the row with the next smaller ``key``; the largest key's after the smallest.

    Rows are dealt into ranges of the key, so no task sees the whole order; each
    range is lent the first row of the range that follows.
    """
    count = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("_key", key)
    ranged = keyed.select("_key").repartitionByRange(count, "_key").groupBy(F.spark_partition_id().alias("part"))
    # One row for each range, written so that every use sees the same ranges.
    tops = cut_lineage(ranged.agg(F.max("_key").alias("top")).select("top"))
    bounded = keyed.withColumn("_bounds", tops.agg(F.array_sort(F.collect_list("top"))).scalar())
    steps = F.lit([1 << i for i in reversed(range(count.bit_length()))])

    def further(at, step):
        # element_at counts from 1: the bound before position at + step.
        return F.when(F.try_element_at("_bounds", at + step) < F.col("_key"), at + step).otherwise(at)

    # How many ranges end below the key, by binary search.
    placed = bounded.withColumn("_range", F.aggregate(steps, F.lit(0), further)).withColumn("_ranges", F.size("_bounds")).drop("_bounds")
    # Not more rows than ranges; rows that repeat a key count once.
    heads = placed.join(F.broadcast(tops), F.col("_key").eqNullSafe(F.col("top")), "left_semi").dropDuplicates(["_key"])
    lent = heads.withColumn("_range", (F.col("_range") + 1) % F.col("_ranges")).withColumn("_lent", F.lit(True))
    order = Window.partitionBy("_range").orderBy("_lent", F.col("_key").desc())
    both = placed.withColumn("_lent", F.lit(False)).unionByName(lent)
    return both.withColumn("_next", F.lead(value).over(order)).where("NOT _lent").drop("_lent", "_range", "_ranges", "_key")


def document_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited version of it, and how like each other they are.

    The edited text has the last floor(n / 2) code points replaced by the first
    as many (or all) of the next text, in descending order of id (of one id, by
    text hash); the last is followed by the first. Returns id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next
    (likeness to the edited and to the next text, 0 to 1), one row per row of ``docs``. NULL texts are
    empty, a NULL id comes last, a single document is followed by itself; texts
    without paragraphs are like each other. Other columns are not read; an empty
    table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("own", paragraph_digests(F.col("text")))
    followed = with_next(rows, F.struct("id", F.xxhash64("text").alias("hash")), F.struct("text", "own"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("_next.text", half))
    changed = followed.select("id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), "own", F.col("_next.own").alias("next"))
    cut = changed.withColumn("new", paragraph_digests(F.col("edited")))
    return cut.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
