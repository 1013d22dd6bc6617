"""Near-duplicates by HyperMinHash: bands over compressed registers, then estimates, then full sets.

Documents with equal shingle sets are one class. A class has one register per
bucket: of the smallest hash in it, the number of leading zeros and the next
bits. Bands of registers make groups of classes that may be similar.

Two rounds, whatever the data:

1. In each group one leader (the class in the most and largest groups) meets the
   others: one pair per member at most. A group of two is done then, and so is a
   group whose members are all linked to each other over leaders.
2. Members of what is left are split by a prefix filter on their full sets:
   shingles are ordered by rarity, those that only one component holds first;
   two classes of different components meet only in a shingle that is early
   enough in both for the similarity, and only if what follows it can still hold
   enough common ones. Edited copies of one text or pages of one template begin with
   shingles of their own, so they do not meet; no link is lost by this.

In both rounds a pair is estimated from the registers first, and what may be
similar is confirmed on the full sets, which are made and written once. The
pairs of the second round are bounded by the classes of other components that
share an early shingle, not by a group's size; many classes that are barely below
the similarity and have next to no shingles of their own would still meet.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from leadspark.llm.common import map_texts
from leadspark.llm.components import component_labels, merged
from leadspark.llm.url_filter import bloom_blocks, bloom_hit
from leadspark.llm.words import WordNumbers, mixed, runs
from leadspark.session import cut_lineage

# 36 bands of 6 registers: a pair at 0.85 is missed with (1 - 0.85^6)^36 = 4e-8, one at 0.3 meets with 0.03.
BANDS, BAND_ROWS = 36, 6
REGISTERS = BANDS * BAND_ROWS
MANTISSA = 10
# Two different minima agree in leading zeros (1/3) and in the mantissa bits.
COLLISION = 1 / (3 << MANTISSA)
# Estimates may fall this many standard deviations short before a pair is given up.
DEVIATIONS = 5.5
PROBES = 64
# Bits of the Bloom filter for each wanted id; at most FILTER_BLOCKS blocks of 256 bits (8 MB) are broadcast.
FILTER_BITS = 16
FILTER_BLOCKS = 262_144
_EMPTY = np.uint64(2**64 - 1)


def shingle_hashes(text: bytes | None, width: int, numbers: WordNumbers) -> np.ndarray:
    """The set of a text's shingles as ascending 64-bit hashes."""
    words = text.lower().split() if text else []  # of bytes: only A-Z change, only ASCII white space parts
    if not words:
        return np.zeros(0, np.uint64)
    hashed = numbers.of(words)[:, 0]
    if len(words) < width:
        return mixed(runs(hashed, len(words), 0) + np.uint64(len(words)))
    return np.unique(runs(hashed, width, 0))


def probe_table() -> np.ndarray:
    """For each bucket, the buckets to borrow from when it is empty."""
    seeds = np.arange(REGISTERS * PROBES, dtype=np.uint64) + np.uint64(0x5BD1E995)
    return (mixed(seeds) % np.uint64(REGISTERS)).astype(np.int64).reshape(REGISTERS, PROBES)


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set; 0 is an empty bucket."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashed = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    bucket = ((hashed >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    least = np.full(len(sets) * REGISTERS, _EMPTY)
    np.minimum.at(least, owner * REGISTERS + bucket, np.minimum(mixed(hashed + np.uint64(1)), _EMPTY - np.uint64(1)))
    _, bits = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = (53 - bits).astype(np.uint64)
    mantissa = (least << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    packed = (zeros << np.uint64(MANTISSA) | mantissa) + np.uint64(1)
    return np.where(least == _EMPTY, 0, packed).astype(np.uint16).reshape(len(sets), REGISTERS)


def band_keys(registers: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """BANDS keys per row, over registers whose empty buckets borrow from filled ones."""
    filled = registers.copy()
    for step in range(PROBES):
        rows, columns = np.nonzero(filled == 0)
        if not len(rows):
            break
        filled[rows, columns] = registers[rows, probes[columns, step]]
    for row in np.flatnonzero((filled == 0).any(axis=1)):  # very few shingles: the next filled bucket
        held = np.flatnonzero(registers[row])
        if len(held):
            empty = np.flatnonzero(filled[row] == 0)
            filled[row, empty] = registers[row, held[np.searchsorted(held, empty) % len(held)]]
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(filled), BANDS)).copy()
    parts = filled.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    for i in range(BAND_ROWS):
        key = mixed(key * np.uint64(65_537) + parts[:, :, i])
    return key.view(np.int64)


def _sketches(width: int):
    numbers = WordNumbers()
    probes = probe_table()

    def of(texts: list[bytes | None]) -> list:
        sets = [shingle_hashes(text, width, numbers) for text in texts]
        registers = registers_of(sets)
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        raw = [row.tobytes() for row in registers]
        return [[len(s) for s in sets], keys, raw, band_keys(registers, probes).tolist()]

    return of


def _sets(width: int):
    numbers = WordNumbers()
    made: set[bytes] = set()  # a task tells each class once

    def of(texts: list[bytes | None]) -> list:
        keys: list[bytes | None] = []
        sets = []
        for text in texts:
            hashes = shingle_hashes(text, width, numbers)
            key = xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None
            new = key is not None and key not in made
            keys.append(key if new else None)
            sets.append(hashes.view(np.int64) if new else None)
            if new:
                made.add(key)
        return [keys, sets]

    return of


def estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, corrected for chance agreement; registers in use."""
    used = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    agree = ((a == b) & (a > 0)).sum(axis=1) / used
    return np.maximum(0.0, (agree - COLLISION) / (1 - COLLISION)), used


# Columns of a class in a pair, by side.
_OF_CLASS = {"key": "key", "registers": "r", "n": "n", "first_id": "id"}


def _promising(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can have the similarity, by their sizes and the estimate, with an id of each class."""
    one, other = (
        sketches.select(*[F.col(c).alias(n + side) for c, n in _OF_CLASS.items()]).withColumnRenamed("key" + side, side)
        for side in ("a", "b")
    )
    sized = pairs.join(merged(other), "b").join(merged(one), "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    sized = sized.select("a", "b", "ida", "idb", "ra", "rb")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in sized.schema.fields[:4]])
    least = percent / 100

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            ra, rb = (
                np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for n in ("ra", "rb")
            )
            guess, used = estimates(ra, rb)
            fair = guess >= least - DEVIATIONS * np.sqrt(least * (1 - least) / used)
            columns = [column.cast(field.type) for column, field in zip(batch.columns[:4], arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow).filter(pa.array(fair))

    return sized.mapInArrow(run, schema)


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, hashes) of the ``wanted`` classes (key, id: a document of it), one row for each.

    Only documents that pass a Bloom filter of the ids make their sets again (its
    size follows their number, up to 8 MB: beyond some millions of ids more
    documents pass). The join on the class key takes the others out. Any number of
    copies may pass: a task tells a class once, before the shuffle, and what
    several tasks tell becomes one row.
    """
    ids = wanted.select("id")
    size = min(FILTER_BLOCKS, max(1, ids.count() * FILTER_BITS // 256))
    blocks = F.broadcast(bloom_blocks(ids, size, "id"))
    chosen = bloom_hit(docs, blocks, size, "id").select("id", "text")
    made = map_texts(
        chosen, [("key", "binary"), ("hashes", "array<bigint>")], lambda: _sets(width), id_col="id", text_col="text"
    )
    made = made.where("key IS NOT NULL").select("key", "hashes")
    return made.join(merged(wanted.select("key")), "key", "left_semi").dropDuplicates(["key"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full ``sets`` have the similarity."""
    one = sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha"))
    other = sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    joined = pairs.select("a", "b").join(merged(other), "b").join(merged(one), "a")
    linked = 100 * both >= percent * (F.size("ha") + F.size("hb") - both)
    return joined.where(linked).select("a", "b")


def _rest(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, part) of the classes of ``groups`` (band, key) that hold more than one component."""
    parted = groups.join(merged(labels), "key", "left").select(
        "band", "key", F.xxhash64(F.coalesce("label", "key")).alias("part")
    )
    uneven = parted.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    return parted.join(merged(uneven.select("band")), "band", "left_semi").select("key", "part").distinct()


def _meeting(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes of different components in ``rest`` (key, part) that a prefix filter leaves.

    Every pair that has the similarity is among them. With sizes na >= nb it has
    at least p * (na + nb) / (100 + p) common shingles. So its first common one (in one
    order of all shingles) is among the first na - p * na / 100 + 1 of the larger and
    the first nb - 2 * p * nb / (100 + p) + 1 of the smaller set (required numbers rounded up).
    """
    held = rest.join(merged(sets), "key").select(
        "key", "part", F.size("hashes").cast("bigint").alias("n"), F.explode("hashes").alias("shingle")
    )
    known = held.groupBy("shingle").agg(
        F.count("*").alias("times"), (F.min("part") < F.max("part")).alias("common")
    )
    order = Window.partitionBy("key").orderBy("common", "times", "shingle")
    placed = held.join(merged(known), "shingle").withColumn("place", F.row_number().over(order))
    early = placed.where(f"common AND place <= n - (({percent} * n + 99) DIV 100) + 1")

    def side(rows: DataFrame, name: str) -> DataFrame:
        columns = [F.col(c).alias(c + name) for c in ("key", "part", "n", "place")]
        return rows.select(F.col("shingle").alias("shingle" + name), *columns)

    least = 100 + percent
    larger = side(early, "_a")
    smaller = side(early.where(f"place <= n - ((2 * {percent} * n + {least - 1}) DIV {least}) + 1"), "_b")
    met = larger.join(
        merged(smaller),
        F.expr(
            "shingle_a = shingle_b AND part_a <> part_b AND (n_a > n_b OR n_a = n_b AND key_a > key_b)"
            f" AND 100 * n_b >= {percent} * n_a"
            f" AND {least} * (1 + least(n_a - place_a, n_b - place_b)) >= {percent} * (n_a + n_b)"
        ),
    )
    return met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def near_components(
    docs: DataFrame, *, width: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Classes of documents that are linked, directly or over others.

    A document's set is its distinct shingles of ``width`` words (A-Z in lower
    case, parted by ASCII white space); fewer words are one shingle. Documents
    are linked from ``percent`` per cent Jaccard similarity on, confirmed on the
    full sets (64-bit shingle hashes). Returns id, n_shingles, component_id (the
    smallest id reachable) and kept (id = component_id), one row per row of
    ``docs``. NULL texts and texts without words have no shingles, and are
    linked with nothing. Repeated rows are copies of each other. A NULL id is
    never the smallest; it is kept only where it is alone. Other columns are not
    read; an empty table gives no rows.

    Which classes are compared rests on the bands (see BANDS); nothing else loses
    a link. Registers, groups, sets of the classes in question and links are written
    to the checkpoint folder.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    sketched = cut_lineage(
        map_texts(
            texts,
            [("n", "bigint"), ("key", "binary"), ("registers", "binary"), ("bands", "array<bigint>")],
            lambda: _sketches(width),
            id_col="id",
            text_col="text",
        )
    )
    classes = sketched.where("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("first_id"), *[F.any_value(c).alias(c) for c in ("n", "registers", "bands")]
    )
    banded = classes.select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = cut_lineage(banded.join(merged(shared), "band"))
    crowd = members.groupBy("key").agg(F.sum("size").alias("crowd"), F.max("size").alias("widest"))
    active = cut_lineage(classes.join(merged(crowd), "key").select("key", "first_id", "n", "registers", "crowd", "widest"))
    ranked = members.join(merged(active.select("key", "crowd")), "key")
    leaders = ranked.groupBy("band").agg(F.max(F.struct("crowd", "key")).getField("key").alias("leader"))
    led = members.join(merged(leaders), "band").where("key <> leader")
    first = led.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()
    first = cut_lineage(_promising(first, active, percent))
    wanted = [first.select(F.col(c).alias("key"), F.col("id" + c).alias("id")) for c in ("a", "b")]
    wanted += [active.where("widest > 2").select("key", F.col("first_id").alias("id"))]
    wanted = cut_lineage(reduce(DataFrame.unionByName, wanted).dropDuplicates(["key"]))
    sets = cut_lineage(_full_sets(texts, wanted, width))
    stars = cut_lineage(component_labels(_confirmed(first, sets, percent)))
    labels = stars.withColumnRenamed("node", "key")
    rest = cut_lineage(_rest(led.where("size > 2").select("band", "key"), labels))
    second = cut_lineage(_promising(_meeting(rest, sets, percent), active, percent))
    stars = stars.select(F.col("node").alias("u"), F.col("label").alias("v"))
    labels = component_labels(_confirmed(second, sets, percent), stars).withColumnRenamed("node", "key")
    named = classes.select("key", "first_id").join(merged(labels), "key", "left")
    named = named.withColumn("label", F.coalesce("label", "key"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_key = named.join(merged(smallest), "label").select("key", "component_id")
    found = sketched.select("id", "n", "key").join(merged(of_key), "key", "left")
    component = F.coalesce("component_id", "id")
    alone = F.col("component_id").isNull()
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (alone | F.col("id").eqNullSafe(component)).alias("kept"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id (then text hash).

    Rows are told apart by id and text. Of rows that repeat both, the one stays whose
    columns come first as JSON text.
    """
    mark = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    marked = docs.select(mark.alias("mark"), F.col(text_col).alias("text"))
    found = near_components(marked, id_col="mark", **parameters).where("kept")
    kept = found.groupBy("mark").agg(F.count("*").alias("_times")).withColumnRenamed("mark", "_mark")
    met = docs.select(F.struct("*").alias("_row"), mark.alias("_mark")).join(kept, "_mark")
    once = met.where("_times = 1").select("_row.*")
    again = met.where("_times > 1").groupBy("_mark").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*")
    return once.unionByName(again)
