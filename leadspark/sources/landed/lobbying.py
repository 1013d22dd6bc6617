"""Lobbying registers: US filings, the Canadian registry, the EU register, US foreign agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.sources.landed.common import as_contract, bar_list, day, joined, number, text

US_FILING = """
    filing_uuid string, filing_type string, filing_year int, filing_period string, filing_document_url string,
    posted_by_name string, income string, expenses string,
    registrant struct<id:string,name:string>,
    client struct<id:string,name:string,country:string,ppb_country:string,client_self_select:boolean,general_description:string>,
    lobbying_activities array<struct<general_issue_code:string,description:string,
        lobbyists:array<struct<lobbyist:struct<id:string,first_name:string,last_name:string>,covered_position:string>>>>,
    foreign_entities array<struct<name:string,country:string,ppb_country:string>>
"""
US_CONTRIBUTION_REPORT = """
    filing_uuid string,
    contribution_items array<struct<payee_name:string,honoree_name:string,amount:string,contributor_name:string>>
"""
# Reporting periods as first and last day within the filing year.
US_PERIODS = {
    "first_quarter": ("01-01", "03-31"),
    "second_quarter": ("04-01", "06-30"),
    "third_quarter": ("07-01", "09-30"),
    "fourth_quarter": ("10-01", "12-31"),
    "mid_year": ("01-01", "06-30"),
    "year_end": ("07-01", "12-31"),
}


def _choice(value: Column, options: dict[str, str], default: Column | None = None) -> Column:
    chosen = default if default is not None else F.lit(None).cast("string")
    for key, result in options.items():
        chosen = F.when(value == key, F.lit(result)).otherwise(chosen)
    return chosen


def us_registrations(filings: DataFrame, register: str = "us/lda/lobbying-disclosures") -> DataFrame:
    """One row per filing. A registrant filing for itself has no client; income stands before expenses."""
    period = F.col("filing_period")
    year = F.when(F.col("filing_year") != 0, F.col("filing_year").cast("string"))
    first = _choice(period, {key: days[0] for key, days in US_PERIODS.items()}, F.lit("01-01"))
    last = _choice(period, {key: days[1] for key, days in US_PERIODS.items()}, F.lit("12-31"))
    own = F.coalesce("client.client_self_select", F.lit(False))
    spend = F.coalesce(number("income"), number("expenses"))
    return as_contract(
        filings.select(
            F.col("filing_uuid").alias("registration_id"),
            F.lit(register).alias("register"),
            F.concat(year, F.lit("-"), first).alias("period_start"),
            F.concat(year, F.lit("-"), last).alias("period_end"),
            F.col("registrant.id").alias("registrant_id"),
            F.col("registrant.name").alias("registrant_name"),
            F.when(~own, F.col("client.id")).alias("client_id"),
            F.when(~own, F.col("client.name")).alias("client_name"),
            text("client.country").alias("client_country"),
            spend.alias("spend_low"),
            spend.alias("spend_high"),
            bar_list(F.col("lobbying_activities.general_issue_code")).alias("issue_area"),
            "filing_type",
            F.col("filing_document_url").alias("url"),
            text("client.general_description").alias("client_description"),
            text("client.ppb_country").alias("client_ppb_country"),
            "posted_by_name",
        ),
        "lobbying_registrations",
    )


def us_foreign_entities(filings: DataFrame) -> DataFrame:
    entity = filings.select("filing_uuid", F.explode("foreign_entities").alias("e"))
    return as_contract(
        entity.select(
            F.col("filing_uuid").alias("registration_id"),
            F.col("e.name").alias("foreign_entity_name"),
            text("e.country").alias("country"),
            text("e.ppb_country").alias("ppb_country"),
        ),
        "lobbying_foreign_entities",
    )


def us_activities(filings: DataFrame) -> DataFrame:
    activity = filings.select("filing_uuid", F.posexplode("lobbying_activities").alias("n", "a"))
    return as_contract(
        activity.select(
            F.col("filing_uuid").alias("registration_id"),
            F.col("a.general_issue_code").alias("general_issue_code"),
            text("a.description").alias("description"),
            F.col("n").alias("activity_index"),
        ),
        "lobbying_activities",
    )


def us_lobbyists(filings: DataFrame) -> DataFrame:
    """One row per filing, person and covered position, over all activities of the filing.

    The first spelling of a name stays when person and position repeat.
    """
    named = (
        filings.select("filing_uuid", F.posexplode("lobbying_activities").alias("n", "a"))
        .select("filing_uuid", "n", F.posexplode("a.lobbyists").alias("m", "entry"))
        .select(
            F.col("filing_uuid").alias("registration_id"),
            F.col("entry.lobbyist.id").alias("lobbyist_id"),
            text("entry.covered_position").alias("former_public_office"),
            F.struct("n", "m").alias("place"),
            joined("entry.lobbyist.first_name", "entry.lobbyist.last_name").alias("name"),
        )
    )
    return as_contract(
        named.groupBy("registration_id", "lobbyist_id", "former_public_office").agg(F.min_by("name", "place").alias("name")),
        "lobbyists",
    )


def us_contributions(reports: DataFrame) -> DataFrame:
    item = reports.select("filing_uuid", F.explode("contribution_items").alias("i"))
    return as_contract(
        item.select(
            F.col("filing_uuid").alias("registration_id"),
            text("i.payee_name").alias("payee_name"),
            text("i.honoree_name").alias("honoree_name"),
            number("i.amount").alias("amount"),
            text("i.contributor_name").alias("contributor_name"),
        ),
        "political_contributions",
    )


# ---------------------------------------------------------------- Canada (CSV files with header)

# Registration types and the register's page of a registration.
CA_TYPES = {"1": "consultant", "2": "in-house corporation", "3": "in-house organization"}
CA_URL = "https://lobbycanada.gc.ca/app/secure/ocl/lrs/do/vwRg?cno=%s&regId=%s"


def _clean(df: DataFrame) -> DataFrame:
    return df.select(*[text(F.col(f"`{name}`")).alias(name.strip()) for name in df.columns])


def _ca_subjects(subject_rows: list[tuple[DataFrame, str]], codes: DataFrame) -> DataFrame:
    """Subject names per record, joined by a bar in name order.

    A code is named once per record before the list is made.
    """
    mentions = None
    for rows, key in subject_rows:
        rows = _clean(rows)
        parts = [name for name in ("SUBJECT_CODE_OBJET", "ASSOC_SUBJECT_CODES_OBJET") if name in rows.columns]
        found = rows.select(
            F.col(key).alias("record"),
            F.explode(F.regexp_extract_all(F.concat_ws(" ", *parts), F.lit(r"(SMT-\d+)"), 1)).alias("code"),
        )
        mentions = found if mentions is None else mentions.unionByName(found)
    names = _clean(codes).select(
        F.col("SUBJECT_CODE_OBJET").alias("code"), F.coalesce("SMT_EN_DESC", "SUBJECT_CODE_OBJET").alias("label")
    )
    named = mentions.distinct().join(names, "code", "left").select("record", F.coalesce("label", "code").alias("label"))
    return (
        named.distinct().groupBy("record").agg(F.array_join(F.array_sort(F.collect_list("label")), "|").alias("subjects"))
    )


def _ca_registration_rows(registrations: DataFrame) -> DataFrame:
    consultant = F.col("REG_TYPE_ENR") == "1"
    client = F.coalesce("EN_CLIENT_NM_AN", "FR_CLIENT_NM")
    person = joined("RGSTRNT_1ST_NM_PRENOM_DCLRNT", "RGSTRNT_LAST_NM_DCLRNT")
    in_house_id = F.concat(F.lit("org-"), "CLIENT_NUM")
    return _clean(registrations).select(
        F.col("REG_ID_ENR").alias("registration_id"),
        day("EFFECTIVE_DATE_VIGUEUR").alias("period_start"),
        day("END_DATE_FIN").alias("period_end"),
        F.when(consultant, F.col("RGSTRNT_NUM_DECLARANT")).otherwise(in_house_id).alias("registrant_id"),
        F.when(consultant, person).otherwise(client).alias("registrant_name"),
        F.when(consultant, F.col("CLIENT_NUM")).alias("client_id"),
        F.when(consultant, client).alias("client_name"),
        _choice(F.col("REG_TYPE_ENR"), CA_TYPES, F.col("REG_TYPE_ENR")).alias("filing_type"),
        F.format_string(CA_URL, F.coalesce("CLIENT_NUM", F.lit("None")), F.col("REG_ID_ENR")).alias("url"),
        F.col("CLIENT_PROFILE_ID_PROFIL_CLIENT").alias("profile"),
    )


def ca_registrations(
    registrations: DataFrame,
    subject_rows: list[DataFrame],
    codes: DataFrame,
    register: str = "ca/ocl/registry-of-lobbyists",
) -> DataFrame:
    """Registrations with their subjects. A consultant registers as a person, others as an organisation."""
    subjects = _ca_subjects([(rows, "REG_ID_ENR") for rows in subject_rows], codes)
    rows = _ca_registration_rows(registrations).join(
        subjects.withColumnRenamed("record", "registration_id"), "registration_id", "left"
    )
    return as_contract(
        rows.withColumn("register", F.lit(register)).withColumnRenamed("subjects", "issue_area"),
        "lobbying_registrations",
    )


def ca_lobbyists(
    registrations: DataFrame, consultants: DataFrame, in_house: DataFrame, offices: DataFrame
) -> DataFrame:
    """Lobbyists per registration and former office; a lobbyist without one has a single row."""
    filed = _ca_registration_rows(registrations)
    by_consultant = filed.filter("filing_type = 'consultant'").select("registration_id", "registrant_id", "profile")
    by_profile = filed.filter("filing_type <> 'consultant' OR filing_type IS NULL").select("registration_id", "profile")

    def person(rows: DataFrame, first_name: str) -> DataFrame:
        rows = _clean(rows)
        declarant = [F.col("RGSTRNT_NUM_DECLARANT").alias("registrant_id")] if "RGSTRNT_NUM_DECLARANT" in rows.columns else []
        return rows.select(
            F.col("CLIENT_PROFILE_ID_PROFIL_CLIENT").alias("profile"),
            F.col("LBBYST_ID_LBBYST").alias("lobbyist_id"),
            joined(first_name, "LBBYST_LAST_NM_LBBYST").alias("name"),
            *declarant,
        )

    people = (
        person(consultants, "LBBYST_1ST_NM_PRENOM_LBBYST")
        .join(by_consultant, ["registrant_id", "profile"])
        .select("registration_id", "lobbyist_id", "name")
        .unionByName(
            person(in_house, "LBBYST_FIRST_NM_PRENOM_LBBYST")
            .join(by_profile, "profile")
            .select("registration_id", "lobbyist_id", "name")
        )
    )
    held = _clean(offices).select(
        F.col("LOBBYIST_ID_LOBBYISTE").alias("lobbyist_id"),
        F.coalesce("TITLE_TITRE", "`POH_DETAILS _PRE_V5_INFO_TCP`").alias("former_public_office"),
        F.col("INSTITUTION").alias("former_office_institution"),
        F.coalesce(day("POS_END_DATE_FIN_POSTE"), day("DPOH_LAST_DATE_FIN_TCPD")).alias("former_office_end"),
    )
    return as_contract(people.join(held, "lobbyist_id", "left"), "lobbyists")


def ca_contacts(reports: DataFrame, officials: DataFrame, subject_rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Officials of the communication reports in force: a report that a later one replaces is left out."""
    reports = _clean(reports)
    replaced = reports.select(F.col("PREV_COMLOG_ID_PRECEDNT").alias("COMLOG_ID")).filter("COMLOG_ID IS NOT NULL").distinct()
    consultant = F.coalesce(F.col("REG_TYPE_ENR") == "1", F.lit(False))
    client = F.coalesce("EN_CLIENT_ORG_CORP_NM_AN", "FR_CLIENT_ORG_CORP_NM")
    person = joined("RGSTRNT_1ST_NM_PRENOM_DCLRNT", "RGSTRNT_LAST_NM_DCLRNT")
    in_force = reports.join(replaced, "COMLOG_ID", "left_anti").select(
        "COMLOG_ID",
        F.when(consultant, F.col("REGISTRANT_NUM_DECLARANT"))
        .otherwise(F.concat(F.lit("org-"), "CLIENT_ORG_CORP_NUM"))
        .alias("registrant_id"),
        F.when(consultant, person).otherwise(client).alias("registrant_name"),
        day("COMM_DATE").alias("contact_date"),
    )
    named_other = F.col("INSTITUTION").isNull() | (F.col("INSTITUTION") == "Other")
    met = _clean(officials).select(
        "COMLOG_ID",
        joined("DPOH_FIRST_NM_PRENOM_TCPD", "DPOH_LAST_NM_TCPD").alias("official_name"),
        F.col("DPOH_TITLE_TITRE_TCPD").alias("official_title"),
        F.when(named_other, F.coalesce("OTHER_INSTITUTION_AUTRE", "INSTITUTION"))
        .otherwise(F.col("INSTITUTION"))
        .alias("institution"),
    )
    subjects = _ca_subjects([(subject_rows, "COMLOG_ID")], codes).withColumnRenamed("record", "COMLOG_ID")
    return as_contract(
        met.join(in_force, "COMLOG_ID")
        .join(subjects, "COMLOG_ID", "left")
        .withColumnRenamed("COMLOG_ID", "contact_id")
        .withColumnRenamed("subjects", "subject"),
        "lobbying_contacts",
    )


# ---------------------------------------------------------------- European Union (XML)

_MONEY = "struct<absoluteCost:string,range:struct<min:string,max:string>>"
EU_REPRESENTATIVE = f"""
    identificationCode string, registrationDate string, registrationCategory string,
    name struct<originalName:string>, headOffice struct<country:string>,
    interests struct<interest:array<struct<name:string>>>,
    financialData struct<closedYear:struct<startDate:string,endDate:string,costs:{_MONEY},
        clients:struct<client:array<struct<name:string,revenue:{_MONEY}>>>>>
"""
EU_MEETING = """
    date string, dgname string, dgacronym string, cabinet string, location string, subject string,
    entities struct<entity:array<struct<id:string,name:string>>>,
    representatives struct<representative:array<struct<name:string,title:string>>>
"""


def _band(money: Column) -> tuple[Column, Column]:
    """Bounds of a money element: an exact cost, or a range whose missing minimum is zero."""
    exact, low, high = (
        number(money["absoluteCost"]),
        number(money["range"]["min"]),
        number(money["range"]["max"]),
    )
    lower = F.coalesce(exact, low, F.when(high.isNotNull(), F.lit(0.0)))
    return lower, F.coalesce(exact, high, low)


def eu_registrations(representatives: DataFrame, register: str = "eu/transparency-register/lobbying") -> DataFrame:
    """One row per client with its revenue, or one row with the own costs and country."""
    year = F.col("financialData.closedYear")
    clients = year["clients"]["client"]
    has_clients = clients.isNotNull() & (F.size(clients) > 0)
    client_type = "struct<name:string,revenue:struct<absoluteCost:string,range:struct<min:string,max:string>>>"
    rows = representatives.select(
        text("identificationCode").alias("registration_id"),
        F.coalesce(text(year["startDate"]), F.substring(text("registrationDate"), 1, 10)).alias("period_start"),
        text(year["endDate"]).alias("period_end"),
        text("name.originalName").alias("registrant_name"),
        bar_list(F.transform(F.col("interests.interest.name"), lambda name: F.trim(name)), repeats=True).alias(
            "issue_area"
        ),
        text("registrationCategory").alias("filing_type"),
        text("headOffice.country").alias("own_country"),
        year["costs"].alias("costs"),
        has_clients.alias("has_clients"),
        F.explode_outer(F.when(has_clients, clients).otherwise(F.array(F.lit(None).cast(client_type)))).alias("c"),
    )
    client_low, client_high = _band(F.col("c.revenue"))
    own_low, own_high = _band(F.col("costs"))
    return as_contract(
        rows.select(
            "*",
            F.lit(register).alias("register"),
            F.col("registration_id").alias("registrant_id"),
            F.when(F.col("has_clients"), text("c.name")).alias("client_name"),
            F.when(~F.col("has_clients"), F.col("own_country")).alias("client_country"),
            F.when(F.col("has_clients"), client_low).otherwise(own_low).alias("spend_low"),
            F.when(F.col("has_clients"), client_high).otherwise(own_high).alias("spend_high"),
        ),
        "lobbying_registrations",
    )


def _distinct(records: str, *fields: str) -> Column:
    """The distinct records of a list, by the text of some fields."""
    return F.array_distinct(F.transform(records, lambda item: F.struct(*[text(item[name]).alias(name) for name in fields])))


def eu_contacts(meetings: DataFrame, export_name: str) -> DataFrame:
    """Organisations times officials of each meeting; repeated meetings collapse on a content hash.

    Meetings are brought together with their lists and expanded there, so the product is never shuffled.
    """
    institution = F.coalesce(
        F.when(
            text("dgname").isNotNull(),
            F.format_string("%s (%s)", text("dgname"), F.coalesce(text("dgacronym"), F.lit("None"))),
        ),
        text("cabinet"),
    )
    parts = [F.lit(export_name), institution, text("date"), text("location"), text("subject")]
    key = F.concat_ws("\x1f", *[F.coalesce(part, F.lit("None")) for part in parts])
    met = (
        meetings.select(
            F.substring(F.sha2(key, 256), 1, 16).alias("contact_id"),
            text("date").alias("contact_date"),
            institution.alias("institution"),
            text("subject").alias("subject"),
            _distinct("representatives.representative", "name", "title").alias("people"),
            _distinct("entities.entity", "id", "name").alias("organisations"),
        )
        .repartition("contact_id")
        .withColumn("e", F.explode("organisations"))
        .withColumn("p", F.explode("people"))
        .select(
            "contact_id",
            F.col("e.id").alias("registrant_id"),
            F.col("e.name").alias("registrant_name"),
            "contact_date",
            F.col("p.name").alias("official_name"),
            F.col("p.title").alias("official_title"),
            "institution",
            "subject",
        )
    )
    return as_contract(met.dropDuplicates(["contact_id", "registrant_id", "official_name"]), "lobbying_contacts")


# ---------------------------------------------------------------- US foreign agents


def us_foreign_agents(documents: DataFrame, status: str = "active") -> DataFrame:
    """Registrants of a landed list (one JSON text per file in ``value``); a single row may be an object."""
    path = f"$.REGISTRANTS_{status.upper()}.ROW"
    raw = F.get_json_object("value", path)
    rows = F.when(raw.startswith("["), F.from_json(raw, "array<struct<Name:string>>")).otherwise(
        F.array(F.from_json(raw, "struct<Name:string>"))
    )
    return as_contract(
        documents.select(F.explode(rows).alias("r")).filter("r IS NOT NULL").select(text("r.Name").alias("registrant_name")),
        "foreign_agent_registrants",
    )
