"""Detectors over members and what they share (own definitions of draft detectors)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.functions import checks
from leadspark.functions.setjoin import overlapping_sets
from leadspark.session import cut_lineage


def _leads(found: DataFrame, prefix: str, category: str, *extra) -> DataFrame:
    return found.select(
        F.concat(F.lit(f"{prefix}-"), F.col("member_id").cast("string"), F.lit("-"), F.col("other_id").cast("string")).alias("candidate_id"),
        F.lit(category).alias("category"),
        F.lit("medium").alias("severity"),
        "member_id",
        "other_id",
        "members",
        "others",
        F.col("member_size").alias("member_entities"),
        F.col("other_size").alias("other_entities"),
        F.col("common").alias("common_entities"),
        *extra,
    )


def cross_commit_overlap(df: DataFrame, *, minimum_common: int = 3) -> DataFrame:
    """Members (commitments) that share ``minimum_common`` entities or more.

    Reads member and entity; repeated rows count once, NULLs not at all. Members
    with the same entities are one row (member_id = other_id) with their number, and
    pairs are between such groups, each named after its smallest member. No entity is
    too frequent to count: a member looks for partners with its rarest entities only,
    all but ``minimum_common`` - 1, so the entity that everybody has pairs nobody.
    """
    least = checks.integer("minimum_common", minimum_common, 2, 1_000_000)
    prefix = lambda size: size - least + 1
    found = overlapping_sets(df, probe=prefix, index=prefix, required=lambda large, small: F.lit(least))
    return _leads(found, "overlap", "network")


def portfolio_cloning(df: DataFrame, *, minimum_similarity: float = 0.8) -> DataFrame:
    """Members whose portfolios (sets of entities) have a Jaccard similarity of ``minimum_similarity`` or more.

    Reads member and entity (holdings of a judge, clients of a registrant, shingles of a
    text); repeated rows count once, NULLs not at all. Exact: the rarest entities of
    the larger set meet those of the smaller one, sizes and places rule pairs out, and
    common entities are counted. Equal portfolios are one row (member_id = other_id).
    """
    percent = round(1_000_000 * checks.number("minimum_similarity", minimum_similarity, 0.51, 1.0))
    whole = 1_000_000

    def required(large, small):
        return F.ceil(F.lit(percent) * (large + small) / (whole + percent))

    found = overlapping_sets(
        df,
        probe=lambda size: size - F.ceil(F.lit(percent) * size / whole) + 1,
        index=lambda size: size - F.ceil(2 * F.lit(percent) * size / (whole + percent)) + 1,
        required=required,
    )
    union = F.col("member_size") + F.col("other_size") - F.col("common")
    return _leads(found, "clone", "text", (F.col("common") / union).alias("similarity"))


def shared_identifiers(df: DataFrame, *, minimum_entities: int = 2, kinds: list[str] | None = None) -> DataFrame:
    """Entities connected by identifiers they share, each with its shortest chain of evidence.

    Reads entity, kind and identifier (an address, a phone, an account, a server); ``kinds``
    chooses some. A cluster is named after its smallest entity, and an entity's chain leads
    there over the fewest identifiers (of equally short ones the smallest text). Clusters of at least
    ``minimum_entities`` are reported, one row per entity.

    In a round every entity that has come closer to a smaller one tells its identifiers, and these
    tell all their entities: rows are edges of entities and identifiers, so an identifier that very many
    entities share adds one row for each and no pairs. Only what has changed moves on. There are as many
    rounds as the longest chain has links, and one more.
    """
    least = checks.integer("minimum_entities", minimum_entities, 2, 1_000_000_000)
    edges = df.select(
        F.col("entity").alias("entity"), F.col("kind").cast("string").alias("kind"), F.col("identifier").cast("string").alias("identifier")
    ).filter("entity IS NOT NULL AND kind IS NOT NULL AND identifier IS NOT NULL")
    if kinds is not None:
        edges = edges.filter(F.col("kind").isin(*kinds))
    edges = edges.distinct()
    shared = edges.groupBy("kind", "identifier").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    edges = cut_lineage(edges.join(shared, ["kind", "identifier"]))
    # (root, hops, chain): the smallest entity heard of, and the way to it; smaller is better in this order.
    start = F.struct(F.col("entity").alias("root"), F.lit(0).alias("hops"), F.col("entity").cast("string").alias("chain"))
    state = edges.select("entity").distinct().select("entity", start.alias("best"))
    changed = state
    while not changed.isEmpty():
        told = edges.join(changed, "entity").groupBy("kind", "identifier").agg(F.min("best").alias("best"))
        link = F.concat(F.col("best.chain"), F.lit(" ["), F.col("kind"), F.lit(" "), F.col("identifier"), F.lit("] "), F.col("entity").cast("string"))
        heard = F.struct(F.col("best.root").alias("root"), (F.col("best.hops") + 1).alias("hops"), link.alias("chain"))
        offers = edges.join(told, ["kind", "identifier"]).groupBy("entity").agg(F.min(heard).alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("offer") < F.col("best"))
        judged = cut_lineage(
            state.join(offers, "entity", "left").select(
                "entity", F.when(better, F.col("offer")).otherwise(F.col("best")).alias("best"), F.coalesce(better, F.lit(False)).alias("moved")
            )
        )
        state, changed = judged.drop("moved"), judged.filter("moved").drop("moved")
    found = state.select("entity", "best.root", "best.hops", "best.chain")
    sizes = found.groupBy("root").agg(F.count("*").alias("entities")).filter(F.col("entities") >= least)
    return found.join(sizes, "root").select(
        F.concat(F.lit("shared-"), F.col("entity").cast("string")).alias("candidate_id"),
        F.lit("network").alias("category"),
        F.lit("medium").alias("severity"),
        F.col("root").alias("cluster_id"),
        "entity",
        "entities",
        "hops",
        "chain",
    )


def shared_infrastructure(df: DataFrame, *, minimum_entities: int = 3) -> DataFrame:
    """Identifiers (servers, domains, accounts) that at least ``minimum_entities`` entities use, with their reach.

    Reads entity, kind and identifier. A row per identifier: how many entities use it, the
    smallest and largest of them, and how many other such identifiers the busiest of them uses
    (``co_identifiers``). Counts only: entities are counted in tasks before they are
    brought together, and no entity meets another.
    """
    least = checks.integer("minimum_entities", minimum_entities, 2, 1_000_000_000)
    edges = df.select("entity", F.col("kind").cast("string").alias("kind"), F.col("identifier").cast("string").alias("identifier"))
    edges = edges.filter("entity IS NOT NULL AND kind IS NOT NULL AND identifier IS NOT NULL").distinct()
    used = edges.groupBy("kind", "identifier").agg(
        F.count("*").alias("entities"), F.min("entity").alias("first_entity"), F.max("entity").alias("last_entity")
    )
    used = cut_lineage(used.filter(F.col("entities") >= least))
    wide = edges.join(used.select("kind", "identifier"), ["kind", "identifier"])
    # An entity's own number of shared identifiers; the others of an identifier's busiest entity.
    per_entity = wide.groupBy("entity").agg((F.count("*") - 1).alias("others"))
    reach = wide.join(per_entity, "entity").groupBy("kind", "identifier").agg(F.max("others").alias("co_identifiers"))
    return used.join(reach, ["kind", "identifier"]).select(
        F.concat(F.lit("infrastructure-"), "kind", F.lit("-"), "identifier").alias("candidate_id"),
        F.lit("network").alias("category"),
        F.lit("medium").alias("severity"),
        "kind",
        "identifier",
        "entities",
        "first_entity",
        "last_entity",
        "co_identifiers",
    )
