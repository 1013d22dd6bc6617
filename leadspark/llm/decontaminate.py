"""Benchmark decontamination by a prefix-filtered set join on word shingles.

A window of an item is the set of its shingles. For full containment one shingle
of a window is a necessary prefix: the rarest in the corpus. Documents meet the
windows on that shingle only; the place of the shingle fixes where the window
must start, which bounds position and length, and the words there are compared
one by one. Column functions and joins alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the word definition.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3

# The windows are broadcast up to this many, and up to this many bytes of their words and item ids.
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 48_000_000


def words_of(text: Column) -> Column:
    lower = F.translate(text, _UPPER, _LOWER)
    return F.coalesce(F.array_remove(F.split(lower, _BREAK, -1), ""), F.array().cast("array<string>"))


def _shingles(words: str, size: int) -> str:
    """SQL for the hashes of all runs of ``size`` words."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return (
        f"CASE WHEN size({words}) < {size} THEN CAST(array() AS array<bigint>) "
        f"ELSE transform(sequence(0, size({words}) - {size}), i -> xxhash64({size}, {parts})) END"
    )


def item_windows(items: DataFrame, length: int, *, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows (words) of all items, with the ids of the items (as text) that hold them."""
    split = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("all"))
    each = f"transform(sequence(0, size(all) - least(size(all), {length})), i -> slice(all, i + 1, least(size(all), {length})))"
    windows = split.where(F.size("all") > 0).select("item", F.explode(F.expr(each)).alias("words"))
    return windows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _entries(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """The shingles of all documents: rows of ``docs`` with shingle and position (NULL without any)."""
    arrays = [f"({_shingles('words', size)})" for size in sizes]
    hashed = docs.withColumn("_hashes", F.expr(f"concat({', '.join(arrays)})"))
    rows = hashed.select(*docs.columns, F.posexplode_outer("_hashes").alias("_at", "shingle"))
    position = F.col("_at")
    # The shingles of the sizes follow each other in one array.
    for size in sizes[:-1]:
        held = F.greatest(F.col("n_words") - (size - 1), F.lit(0))
        position = F.when(position >= held, position - held).otherwise(position)
    return rows.withColumn("position", position.cast("int"))


def prefixes(windows: DataFrame, docs: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """Per shingle, the windows (offset of the shingle, words, items) whose rarest shingle it is.

    Rarity is the number of places in all documents; equal counts go by hash.
    """
    size = F.least(F.size("words"), F.lit(SHINGLE))
    choices = " ".join(f"WHEN {k} THEN {_shingles('words', k)}" for k in sizes)
    shingled = windows.withColumn("_size", size).select(
        "words", "items", F.posexplode(F.expr(f"CASE _size {choices} END")).alias("offset", "shingle")
    )
    wanted = shingled.select("shingle").distinct()
    seen = _entries(docs, sizes).where("shingle IS NOT NULL").select("shingle")
    counts = seen.join(F.broadcast(wanted) if small else wanted, "shingle").groupBy("shingle").agg(
        F.count("*").alias("places")
    )
    rated = shingled.join(counts, "shingle", "left").withColumn("places", F.coalesce("places", F.lit(0)))
    order = Window.partitionBy("words").orderBy("places", "shingle", "offset")
    rarest = rated.withColumn("_rank", F.row_number().over(order)).where("_rank = 1 AND places > 0")
    return rarest.groupBy("shingle").agg(F.collect_list(F.struct("offset", "words", "items")).alias("windows"))


_VERIFIED = (
    "transform(filter(windows, x -> position >= x.offset AND position - x.offset + size(x.words) <= n_words "
    "AND slice(words, position - x.offset + 1, size(x.words)) = x.words), "
    "x -> struct(position - x.offset AS start, size(x.words) AS length, x.items AS items))"
)


def _hits(docs: DataFrame, first: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """Rows (id, mark, n_words, own, hits): one with own = 1 for each document, others for places that match."""
    entries = _entries(docs, sizes)
    if small:
        met = entries.join(F.broadcast(first), "shingle", "left")
        met = met.where("windows IS NOT NULL OR _at IS NULL OR _at = 0")
        own = F.when(F.col("_at").isNull() | (F.col("_at") == 0), 1).otherwise(0)
        return met.select("id", "mark", "n_words", own.alias("own"), F.expr(_VERIFIED).alias("hits"))
    # Only numbers are dealt by shingle; the words come back by document for the places that match.
    places = entries.where("shingle IS NOT NULL").select("id", "mark", "position", "shingle").distinct()
    places = places.join(first, "shingle").select(
        F.col("id").alias("_id"), F.col("mark").alias("_mark"), "position", "windows"
    )
    same = docs["id"].eqNullSafe(places["_id"]) & docs["mark"].eqNullSafe(places["_mark"])
    found = docs.join(places, same).select(
        "id", "mark", "n_words", F.lit(0).alias("own"), F.expr(_VERIFIED).alias("hits")
    )
    return found.unionByName(
        docs.select("id", "mark", "n_words", F.lit(1).alias("own"), F.lit(None).alias("hits"))
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    length: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item.

    A window is ``length`` consecutive words of an item, or the whole item if it
    has fewer. Returns id, n_words, n_hit, items (ids as text, sorted, of the
    items with a window in the document), n_items and contaminated, one row per
    row of ``docs``. NULL and empty texts have no words, and items without words
    no windows. Repeated items each count; repeated rows of a document each get
    the same result. Other columns are not read. An empty benchmark marks nothing,
    an empty table gives no rows.

    The benchmark's windows are broadcast only while they are few (counted first);
    beyond that they are joined by a shuffle of shingle numbers.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    rows = rows.select("id", F.xxhash64("_text").alias("mark"), words_of(F.col("_text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    windows = item_windows(benchmark, length, id_col=item_id_col, text_col=item_text_col)
    bytes_ = F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " "))
    known = windows.agg(
        F.count("*"), F.coalesce(F.sum(bytes_), F.lit(0)), F.sort_array(F.collect_set(F.least(F.size("words"), F.lit(SHINGLE))))
    ).first()
    small = known[0] <= BROADCAST_WINDOWS and known[1] <= BROADCAST_BYTES
    sizes = sorted(known[2], reverse=True) or [SHINGLE]
    first = prefixes(windows, rows.select("words", "n_words"), sizes, small)
    hits = _hits(rows, first, sizes, small)
    gathered = hits.groupBy("id", "mark").agg(
        F.max("n_words").alias("n_words"),
        F.sum("own").alias("own"),
        F.flatten(F.collect_list("hits")).alias("hits"),
    )
    spans = "array_sort(array_distinct(transform(hits, h -> struct(h.start AS start, h.length AS length))))"
    covered = (
        f"aggregate({spans}, struct(0L AS n, 0 AS upto), (a, s) -> struct("
        "a.n + greatest(0, s.start + s.length - greatest(a.upto, s.start)) AS n, "
        "greatest(a.upto, s.start + s.length) AS upto), a -> a.n)"
    )
    items = "array_sort(array_distinct(flatten(transform(hits, h -> h.items))))"
    return gathered.select(
        F.col("id").alias(id_col),
        "n_words",
        F.expr(covered).alias("n_hit"),
        F.expr(items).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("own").cast("int"))).alias("_own"),
    ).select(
        id_col,
        "n_words",
        "n_hit",
        "items",
        F.size("items").cast("long").alias("n_items"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def item_digest(found: DataFrame) -> DataFrame:
    """:func:`contamination` with the digest of the item ids instead of the ids."""
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.withColumn("items_sha256", digest).drop("items")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **parameters
) -> DataFrame:
    """The rows of ``docs`` that hold no window of a benchmark item, with their own columns.

    Rows are told apart by id and text, so rows that share an id are judged each for itself.
    """
    mark = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    marked = docs.select(mark.alias("mark"), F.col(text_col).alias("text"))
    found = contamination(marked, benchmark, id_col="mark", **parameters).where("contaminated")
    rows = docs.select(F.struct("*").alias("_row"), mark.alias("_mark"))
    return rows.join(found.select(F.col("mark").alias("_mark")).distinct(), "_mark", "left_anti").select("_row.*")
