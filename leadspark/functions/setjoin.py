"""Pairs of members whose sets of entities overlap enough, without pairing all members of an entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.session import cut_lineage

# A hot entity leads to a pair only together with a second one: its sets are more than this, or more than HOT_SHARE
# times their mean size (the pairs of its sets then outnumber the seconds that its sets offer).
HOT_ENTITY = 1000
HOT_SHARE = 2
# The entities of a member with more than ONE_PART are ordered in parts, so that it does not fill one task.
ONE_PART = 1000
_PART_BITS = 6

Size = Callable[[Column], Column]
Required = Callable[[Column, Column], Column]


def distinct_sets(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct sets among ``edges`` (member, entity), and their edges.

    A set is named after its smallest member. Returns (member, size, members: how
    many have this set) and (member, entity, size). Sets are told apart by their
    size and 128 bits that any order of entities adds up to, so no set is gathered.
    """
    held = edges.where("member IS NOT NULL AND entity IS NOT NULL").select("member", "entity").distinct()
    sized = held.groupBy("member").agg(
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("entity")).alias("_one"),
        F.bit_xor(F.xxhash64("entity", F.lit(1))).alias("_other"),
    )
    sets = cut_lineage(
        sized.groupBy("size", "_one", "_other")
        .agg(F.min("member").alias("member"), F.count("*").alias("members"))
        .select("member", "size", "members")
    )
    return sets, held.join(sets.select("member", "size"), "member")


def _too_many(sets: Column, seconds: Column) -> Column:
    """Whether what is in so many sets is looked up together with a further entity, of which its sets offer ``seconds``."""
    return (sets > HOT_ENTITY) | (sets * sets > HOT_SHARE * seconds)


def by_rarity(held: DataFrame) -> DataFrame:
    """(member, entity, size, sets, hot, place): each member's entities numbered from the rarest on.

    ``sets`` is in how many sets an entity is. Numbers come from the sizes of the
    parts before an entity's part and the order within it; most members are one part.
    """
    frequency = held.groupBy("entity").agg(F.count("*").alias("sets"), F.sum("size").alias("_sizes"))
    frequency = frequency.select("entity", "sets", _too_many(F.col("sets"), F.col("_sizes")).alias("hot"))
    wide = F.col("size") > ONE_PART
    slices = F.shiftrightunsigned(F.xxhash64("entity"), 64 - _PART_BITS)
    rows = held.join(frequency, "entity")
    rows = rows.withColumn("_sets", F.when(wide, F.col("sets")).otherwise(0)).withColumn("_slice", F.when(wide, slices).otherwise(0))
    part = ["member", "_sets", "_slice"]
    within = Window.partitionBy(*part).orderBy("sets", F.shiftrightunsigned(F.xxhash64("entity"), 1), "entity")
    earlier = Window.partitionBy("member").orderBy("_sets", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.where(wide).groupBy(*part).agg(F.count("*").alias("_n"))
    before = before.select(*part, F.sum("_n").over(earlier).alias("_before"))
    numbered = rows.withColumn("_nth", F.row_number().over(within)).join(before, part, "left")
    place = F.coalesce("_before", F.lit(0)) + F.col("_nth")
    return numbered.select("member", "entity", "size", "sets", "hot", place.alias("place"))


def _tokens(placed: DataFrame, prefix: Size) -> DataFrame:
    """What a member looks for partners with: the entities of its prefix, the hot ones with a second each.

    Two members whose rarest common entity is hot also share a second, less rare one.
    """
    last = prefix(F.col("size"))
    in_prefix = placed.where(F.col("place") <= last)
    nothing = F.lit(None).cast(placed.schema["entity"].dataType)
    rare = in_prefix.where("NOT hot").select("member", "size", "place", "entity", nothing.alias("second"))
    hot = in_prefix.where("hot").select("member", "size", "place", "entity")
    later = placed.where(F.col("place") <= last + 1).select(
        "member", F.col("entity").alias("second"), F.col("place").alias("_later")
    )
    both = hot.join(later, "member").where("_later > place")
    return rare.unionByName(both.select("member", "size", F.col("_later").alias("place"), "entity", "second"))


def _thirds(tokens: DataFrame, placed: DataFrame, prefix: Size) -> DataFrame:
    """Tokens of two entities, each with every third one that is less rare."""
    later = placed.where(F.col("place") <= prefix(F.col("size")) + 2).select(
        "member", F.col("entity").alias("third"), F.col("place").alias("_later")
    )
    made = tokens.join(later, "member").where("_later > place")
    return made.select("member", "size", F.col("_later").alias("place"), "entity", "second", "third")


def _possible(required: Required) -> tuple[Column, Column]:
    """Whether a set of ``size`` can be the larger, and the smaller one, of a pair of different sets."""
    size = F.col("size")
    # Different sets of one size have at most all but one in common.
    same = required(size, size) <= size - 1
    return (size > 1) & (same | (required(size, size - 1) <= size - 1)), same | (required(size + 1, size) <= size)


def _met(large: DataFrame, small: DataFrame, key: list[str], required: Required) -> DataFrame:
    """(ma, mb, na, nb): members that share a token of the entities ``key`` and can still have enough in common.

    The first entities that two members have in common are a token; what else they share is behind its last place.
    """

    def side(tokens: DataFrame, suffix: str) -> DataFrame:
        return tokens.select(*key, *[F.col(c).alias(n + suffix) for c, n in (("member", "m"), ("size", "n"), ("place", "p"))])

    met = side(large, "a").join(side(small, "b"), key)
    met = met.where((F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ma") > F.col("mb"))))
    most = len(key) + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    least = required(F.col("na"), F.col("nb"))
    met = met.where((least <= most) & (least <= F.when(F.col("na") == F.col("nb"), F.col("nb") - 1).otherwise(F.col("nb"))))
    return met.select("ma", "mb", "na", "nb")


def _candidates(placed: DataFrame, probe: Size, index: Size, required: Required) -> DataFrame:
    """(ma, mb, na, nb): pairs that share a token and can still reach the required number of common entities.

    Two entities that many members show together lead to a pair only with a third
    one, wherever three are required of a member as the smaller one of a pair.
    """
    larger, smaller = _possible(required)
    large, small = _tokens(placed.where(larger), probe), _tokens(placed.where(smaller), index)
    pair, triple = ["entity", "second"], ["entity", "second", "third"]
    offered = F.sum(index(F.col("size")) + 2 - F.col("place"))
    shown = small.where("second IS NOT NULL").groupBy(*pair).agg(F.count("*").alias("_sets"), offered.alias("_thirds"))
    hot = cut_lineage(shown.where(_too_many(F.col("_sets"), F.col("_thirds"))).select(*pair))
    marked = hot.select(F.col("entity").alias("_e"), F.col("second").alias("_s"))
    same = (F.col("entity") == F.col("_e")) & (F.col("second") == F.col("_s"))
    # A smaller member of which only two entities are required shows hot pairs as they are, and so do its partners.
    three, two = required(F.col("size"), F.col("size")) >= 3, required(F.col("size"), F.lit(2)) <= 2
    larges, smalls = large.where("second IS NOT NULL"), small.where("second IS NOT NULL")
    met = _met(large.where("second IS NULL"), small.where("second IS NULL"), ["entity"], required)
    met = met.unionByName(
        _met(larges.join(marked, same & ~two, "left_anti"), smalls.join(marked, same & three, "left_anti"), pair, required)
    )
    longer = _thirds(larges.join(hot, pair, "left_semi"), placed, probe)
    shorter = _thirds(smalls.where(three).join(hot, pair, "left_semi"), placed, index)
    return met.unionByName(_met(longer, shorter, triple, required)).distinct()


def overlapping_sets(edges: DataFrame, *, probe: Size, index: Size, required: Required) -> DataFrame:
    """Pairs of distinct sets with enough common entities, and sets that several members have.

    ``edges`` has member and entity; ``required`` is the number of common entities
    that two sets of given sizes (the larger first) need, two at least unless they are
    equal, and never fewer for larger sets. ``probe`` and ``index`` say how many of its rarest entities the larger and the
    smaller set of a pair must show so that every such pair meets in one of them.

    Returns member_id and other_id (the smallest members of each set, in order;
    the same for one set), members and others (how many have it), member_size,
    other_size and common. Members with the same set are never paired with each
    other. Counts are exact, over the smaller set's entities.
    """
    sets, held = distinct_sets(edges)
    larger, smaller = _possible(required)
    placed = cut_lineage(by_rarity(held.where(larger | smaller)))
    pairs = cut_lineage(_candidates(placed, probe, index, required))
    entities = placed.select("member", "entity")
    asked = pairs.join(entities.withColumnRenamed("member", "mb"), "mb")
    common = asked.join(entities.withColumnRenamed("member", "ma"), ["ma", "entity"]).groupBy("ma", "mb", "na", "nb")
    found = common.agg(F.count("*").alias("common")).where(F.col("common") >= required(F.col("na"), F.col("nb")))
    turned = F.col("ma") > F.col("mb")

    def chosen(one: str, other: str) -> Column:
        return F.when(turned, F.col(other)).otherwise(F.col(one))

    ordered = found.select(
        chosen("ma", "mb").alias("member_id"), chosen("mb", "ma").alias("other_id"),
        chosen("na", "nb").alias("member_size"), chosen("nb", "na").alias("other_size"), "common",
    )
    alike = sets.where((F.col("members") > 1) & (required(F.col("size"), F.col("size")) <= F.col("size")))
    same = alike.select(
        F.col("member").alias("member_id"), F.col("member").alias("other_id"), F.col("size").alias("member_size"),
        F.col("size").alias("other_size"), F.col("size").alias("common"),
    )
    counts = sets.select("member", "members")
    return (
        ordered.unionByName(same)
        .join(counts.withColumnRenamed("member", "member_id"), "member_id")
        .join(counts.select(F.col("member").alias("other_id"), F.col("members").alias("others")), "other_id")
    )
