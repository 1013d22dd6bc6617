"""Parliaments: European Parliament linked data and the Swiss open parliament exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.sources.landed.common import as_contract, day, joined, tail

EP_PERSON = """
    identifier string, label string,
    hasMembership array<struct<organization:string,membershipClassification:string,role:string,
        memberDuring:struct<startDate:string,endDate:string>,represents:array<string>>>
"""
EP_DECISION = """
    id string, identifier string, notation_votingId string, activity_date string, decision_method string,
    activity_label map<string,string>, decided_on_a_realization_of array<string>,
    had_voter_favor array<string>, had_voter_against array<string>, had_voter_abstention array<string>
"""
EP_BODY = "identifier string, label string"
# Fixed values of the linked data.
EP_PARLIAMENT = "EP"
EP_PORTAL = "https://data.europarl.europa.eu"
EP_ROLL_CALL = "def/ep-decision-methods/VOTE_ELECTRONIC_ROLLCALL"
EP_MANDATE = "def/ep-roles/MEMBER_PARLIAMENT"
EP_AFFILIATIONS = {
    "def/ep-entities/EU_POLITICAL_GROUP": "group",
    "def/ep-entities/NATIONAL_POLITICAL_GROUP": "party",
}
EP_VOTERS = {"had_voter_favor": "for", "had_voter_against": "against", "had_voter_abstention": "abstain"}
EP_COUNTRIES = {
    "AUT": "AT", "BEL": "BE", "BGR": "BG", "HRV": "HR", "CYP": "CY", "CZE": "CZ", "DNK": "DK", "EST": "EE",
    "FIN": "FI", "FRA": "FR", "DEU": "DE", "GRC": "EL", "HUN": "HU", "IRL": "IE", "ITA": "IT", "LVA": "LV",
    "LTU": "LT", "LUX": "LU", "MLT": "MT", "NLD": "NL", "POL": "PL", "PRT": "PT", "ROU": "RO", "SVK": "SK",
    "SVN": "SI", "ESP": "ES", "SWE": "SE", "GBR": "UK",
}


def _mapped(options: dict[str, str], value: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(item) for pair in options.items() for item in pair]), value)


def _spans(people: DataFrame) -> DataFrame:
    """Memberships of every person, numbered in their published order."""
    return people.select(
        F.col("identifier").alias("member_id"), "label", F.posexplode("hasMembership").alias("position", "m")
    ).select(
        "member_id",
        F.col("label").alias("name"),
        "position",
        F.col("m.organization").alias("organization"),
        _mapped(EP_AFFILIATIONS, F.col("m.membershipClassification")).alias("affiliation_type"),
        F.col("m.role").alias("role"),
        day("m.memberDuring.startDate").alias("start_date"),
        day("m.memberDuring.endDate").alias("end_date"),
        F.get("m.represents", 0).alias("represents"),
    )


def _roster(people: DataFrame, term: int) -> DataFrame:
    """Spans of the persons with a mandate in the term."""
    spans = _spans(people)
    sitting = spans.filter((F.col("role") == EP_MANDATE) & (F.col("organization") == f"org/ep-{term}"))
    return spans.join(sitting.select("member_id").distinct(), "member_id", "left_semi")


def _group_labels(bodies: DataFrame) -> DataFrame:
    return bodies.select(F.col("identifier").alias("org_id"), F.col("label").alias("org_name"))


def ep_members(people: DataFrame, term: int) -> DataFrame:
    spans = _roster(people, term)
    in_term = (F.col("role") == EP_MANDATE) & (F.col("organization") == f"org/ep-{term}") & F.col("represents").isNotNull()
    code = tail("represents")
    return as_contract(
        spans.groupBy("member_id")
        .agg(
            F.min("name").alias("name"),
            F.min(F.when(in_term, F.struct("position", "represents"))).alias("seat"),
        )
        .withColumn("represents", F.col("seat.represents"))
        .select(
            "member_id",
            F.lit(EP_PARLIAMENT).alias("parliament"),
            "name",
            F.coalesce(_mapped(EP_COUNTRIES, code), code).alias("country"),
        ),
        "parl_members",
    )


def ep_affiliations(people: DataFrame, bodies: DataFrame, term: int) -> DataFrame:
    """Group and party memberships; the term is the first mandate that covers the start.

    A person's mandates and memberships meet by person; both are that person's own record.
    """
    spans = _roster(people, term)
    mandates = spans.filter((F.col("role") == EP_MANDATE) & F.col("organization").startswith("org/ep-")).select(
        "member_id",
        F.col("position").alias("mandate_position"),
        F.substring_index("organization", "org/ep-", -1).alias("mandate_term"),
        F.col("start_date").alias("mandate_start"),
        F.coalesce("end_date", F.lit("9999-12-31").cast("date")).alias("mandate_end"),
    )
    memberships = spans.filter("affiliation_type IS NOT NULL AND start_date IS NOT NULL")
    covering = (
        memberships.select("member_id", "position", "start_date")
        .join(mandates, "member_id")
        .filter("start_date BETWEEN mandate_start AND mandate_end")
        .groupBy("member_id", "position")
        .agg(F.min_by("mandate_term", "mandate_position").alias("term"))
    )
    return as_contract(
        memberships.join(covering, ["member_id", "position"], "left")
        .withColumn("org_id", tail("organization"))
        .join(_group_labels(bodies), "org_id", "left")
        .withColumn("parliament", F.lit(EP_PARLIAMENT)),
        "parl_affiliations",
    )


def _voting_id() -> Column:
    return F.coalesce(
        F.nullif(F.col("notation_votingId"), F.lit("")), F.nullif(F.col("identifier"), F.lit("")), tail("id")
    )


def _roll_calls(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("decision_method") == EP_ROLL_CALL)


def ep_votings(decisions: DataFrame, language: str = "en") -> DataFrame:
    label = F.col("activity_label")
    return as_contract(
        _roll_calls(decisions).select(
            _voting_id().alias("voting_id"),
            F.lit(EP_PARLIAMENT).alias("parliament"),
            day("activity_date").alias("vote_date"),
            F.coalesce(
                F.nullif(F.try_element_at(label, F.lit(language)), F.lit("")),
                F.nullif(F.try_element_at(label, F.lit("en")), F.lit("")),
                F.get(F.map_values(label), 0),
            ).alias("title"),
            tail(F.get("decided_on_a_realization_of", 0)).alias("dossier_id"),
            F.when(F.col("id").startswith("http"), F.col("id"))
            .otherwise(F.concat(F.lit(EP_PORTAL + "/"), "id"))
            .alias("url"),
        ),
        "parl_votings",
    )


def _by_month(spans: DataFrame) -> DataFrame:
    """Spans repeated for each month they touch, so a day finds them by an equality on its month.

    A span open at the end reaches to the last month that holds a vote.
    """
    months = F.sequence(
        F.trunc("start_date", "month"), F.trunc(F.least("end_date", "last_day"), "month"), F.expr("INTERVAL 1 MONTH")
    )
    usable = spans.filter("start_date IS NOT NULL AND start_date <= last_day AND coalesce(end_date, last_day) >= start_date")
    return usable.withColumn("month", F.explode(months))


_ROLL = "array<struct<voting_id:string,vote_day:date,order:int>>"


def _voters(field: str, order: int) -> Column:
    people = F.coalesce(F.col(field), F.array().cast("array<string>"))
    return F.transform(people, lambda person: F.struct(tail(person).alias("member_id"), F.lit(order).alias("order")))


def ep_member_votes(decisions: DataFrame, people: DataFrame, bodies: DataFrame, term: int) -> DataFrame:
    """One row per voting and member: voters, and the members with a mandate that day who did not vote.

    The group is the first one that covers the day (of several labels the smallest). Votes, mandates and
    groups meet once, by member and month; the month's votings (broadcast, a name and a
    day each) are lent to them, and what follows stays in the task. Only votes and spans are shuffled, never the rows of the members who were absent.
    """
    roll_calls = _roll_calls(decisions).withColumn("voting_id", _voting_id()).withColumn("vote_day", day("activity_date"))
    month = F.trunc("vote_day", "month").alias("month")
    votings = roll_calls.where("vote_day IS NOT NULL").select(month, F.struct("voting_id", "vote_day").alias("voting"))
    votings = votings.groupBy("month").agg(F.collect_set("voting").alias("votings"))
    last_day = roll_calls.agg(F.max("vote_day").alias("d")).scalar()
    spans = _roster(people, term).withColumn("last_day", last_day)

    positions = list(EP_VOTERS.values())
    voters = [_voters(field, order) for order, field in enumerate(EP_VOTERS)]
    cast = roll_calls.select("voting_id", "vote_day", F.explode(F.concat(*voters)).alias("v"))
    cast = cast.select("v.member_id", month, F.struct("voting_id", "vote_day", "v.order").alias("vote"))
    mandates = _by_month(spans.filter((F.col("role") == EP_MANDATE) & (F.col("organization") == f"org/ep-{term}")))
    mandates = mandates.select("member_id", "month", F.struct("start_date", "end_date").alias("seat"))
    labels = _group_labels(bodies).groupBy("org_id").agg(F.min("org_name").alias("org_name"))
    groups = _by_month(spans.filter("affiliation_type = 'group'")).withColumn("org_id", tail("organization"))
    groups = groups.join(labels, "org_id", "left").select(
        "member_id", "month", F.struct("position", "org_name", "start_date", "end_date").alias("group")
    )
    told = cast.unionByName(mandates, allowMissingColumns=True).unionByName(groups, allowMissingColumns=True)
    per_month = told.groupBy("member_id", "month").agg(
        F.collect_list("vote").alias("votes"), F.collect_set("seat").alias("seats"), F.array_sort(F.collect_set("group")).alias("groups")
    )

    def covers(span: Column, on: Column) -> Column:
        return on.between(span["start_date"], F.coalesce(span["end_date"], F.lit("9999-12-31").cast("date")))

    seated = F.filter("votings", lambda v: F.exists("seats", lambda seat: covers(seat, v["vote_day"])))
    absent = F.transform(seated, lambda v: F.struct(v["voting_id"].alias("voting_id"), v["vote_day"].alias("vote_day"), F.lit(-1).alias("order")))
    lent = per_month.join(F.broadcast(votings), "month", "left")
    rolled = lent.select(
        "member_id", "month", "groups", F.explode(F.concat("votes", F.coalesce(absent, F.array().cast(_ROLL)))).alias("r")
    )
    of_the_day = F.get(F.filter("groups", lambda group: covers(group, F.col("r.vote_day"))), 0)["org_name"]
    rolled = rolled.select("member_id", "month", "r.voting_id", "r.vote_day", "r.order", of_the_day.alias("group_at_vote"))
    # Later lists win when a member is on two.
    found = rolled.groupBy("member_id", "month", "voting_id", "vote_day", "group_at_vote").agg(F.max("order").alias("order"))
    position = F.coalesce(F.get(F.array(*map(F.lit, positions)), F.nullif(F.col("order"), F.lit(-1))), F.lit("absent"))
    return as_contract(
        found.withColumn("position", position).withColumn("parliament", F.lit(EP_PARLIAMENT)), "parl_member_votes"
    )


# ---------------------------------------------------------------- Switzerland

CH_LANGUAGES = ("de", "fr", "it", "rm", "en")
# Vote and payment codes.
CH_POSITIONS = {
    "yes": "for",
    "no": "against",
    "abstention": "abstain",
    "absent": "absent",
    "absent_excused": "absent",
}
CH_PAYMENT = {"paid": "paid", "honorary": "unpaid"}


def _translated(df: DataFrame, base: str, language: str) -> Column:
    """The wanted language, else the first one that has a text."""
    names = [f"{base}_{suffix}" for suffix in (language, *CH_LANGUAGES)]
    found = [F.nullif(F.col(name), F.lit("")) for name in dict.fromkeys(names) if name in df.columns]
    return F.trim(F.coalesce(*found, F.lit(None).cast("string")))


def ch_votings(votings: DataFrame, groups: DataFrame, parliament: str, language: str = "de") -> DataFrame:
    chambers = groups.select(F.col("id").alias("group_id"), _translated(groups, "name", language).alias("chamber"))
    rows = votings.withColumn("vote_date", day("date")).filter("vote_date IS NOT NULL")
    return as_contract(
        rows.select(
            F.col("id").alias("voting_id"),
            F.lit(parliament).alias("parliament"),
            "group_id",
            "vote_date",
            F.coalesce(_translated(votings, "title", language), _translated(votings, "affair_title", language)).alias("title"),
            F.col("affair_id").alias("dossier_id"),
            F.coalesce(
                _translated(votings, "url_external", language),
                F.concat(F.lit("https://api.openparldata.ch/v1/votings/"), "id"),
            ).alias("url"),
        ).join(chambers, "group_id", "left"),
        "parl_votings",
    )


def ch_member_votes(votes: DataFrame, votings: DataFrame, parliament: str, language: str = "de") -> DataFrame:
    """Votes in known votings; unknown vote codes stay as they are."""
    code = F.lower(F.coalesce("vote", F.lit("")))
    known = votings.select("voting_id").distinct()
    return as_contract(
        votes.join(known, "voting_id", "left_semi").select(
            "voting_id",
            F.lit(parliament).alias("parliament"),
            F.col("person_id").alias("member_id"),
            F.coalesce(_mapped(CH_POSITIONS, code), F.nullif(code, F.lit(""))).alias("position"),
            _translated(votes, "person_parliamentary_group_name", language).alias("group_at_vote"),
        ),
        "parl_member_votes",
    )


def ch_affiliations(member_votes: DataFrame, votings: DataFrame) -> DataFrame:
    """Spans of votes cast under one group label; a member's last span stays open.

    Equal (member, day, label) rows collapse first, so a member keeps at most one
    row per voting day and label in the windows.
    """
    dated = votings.select("parliament", "voting_id", "vote_date").distinct()
    seen = (
        member_votes.filter("member_id IS NOT NULL AND group_at_vote <> ''")
        .join(dated, ["parliament", "voting_id"])
        .select("parliament", "member_id", "vote_date", "group_at_vote")
        .distinct()
    )
    member = Window.partitionBy("parliament", "member_id").orderBy("vote_date", "group_at_vote")
    starts = F.lag("group_at_vote").over(member)
    islands = seen.withColumn(
        "starts", F.when(starts.isNull() | (starts != F.col("group_at_vote")), 1).otherwise(0)
    ).withColumn("island", F.sum("starts").over(member))
    spans = islands.groupBy("parliament", "member_id", "island").agg(
        F.min("group_at_vote").alias("org_name"),
        F.min("vote_date").alias("start_date"),
        F.max("vote_date").alias("last_date"),
    )
    by_island = Window.partitionBy("parliament", "member_id").orderBy("island")
    return as_contract(
        spans.withColumn("end_date", F.when(F.lead("island").over(by_island).isNotNull(), F.col("last_date"))).withColumn(
            "affiliation_type", F.lit("group")
        ),
        "parl_affiliations",
    )


def ch_members(persons: DataFrame, parliament: str, language: str = "de") -> DataFrame:
    return as_contract(
        persons.select(
            F.col("id").alias("member_id"),
            F.lit(parliament).alias("parliament"),
            F.coalesce(F.nullif(F.col("fullname"), F.lit("")), joined("firstname", "lastname")).alias("name"),
            _translated(persons, "electoral_district", language).alias("country"),
        ),
        "parl_members",
    )


def ch_interests(interests: DataFrame, parliament: str, language: str = "de") -> DataFrame:
    return as_contract(
        interests.select(
            F.col("id").alias("interest_id"),
            F.col("person_id").alias("member_id"),
            F.lit(parliament).alias("parliament"),
            _translated(interests, "name", language).alias("organisation"),
            _translated(interests, "role_name", language).alias("role"),
            _mapped(CH_PAYMENT, F.lower("type_payment_harmonized")).alias("paid"),
            F.lit(None).cast("double").alias("income_high"),
            day("end_date").alias("end_date"),
        ),
        "parl_interests",
    )
