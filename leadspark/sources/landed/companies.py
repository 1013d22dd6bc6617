"""Company registers: United Kingdom, legal entity identifiers, Norway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.sources.landed.common import as_contract, day, joined

UK_COMPANY = """
    company_number string, company_name string, title string, company_status string, date_of_creation string,
    date_of_cessation string, previous_company_names array<struct<name:string>>,
    registered_office_address struct<po_box:string,premises:string,address_line_1:string,address_line_2:string,
        locality:string,region:string,postal_code:string>
"""
UK_OFFICER = """
    company_number string, company_name string, name string, officer_role string, appointed_on string,
    resigned_on string, links struct<officer:struct<appointments:string>>
"""
UK_CONTROLLER = """
    company_number string, kind string, name string, description string, country_of_residence string,
    natures_of_control array<string>, notified_on string, ceased_on string,
    date_of_birth struct<year:int,month:int>,
    identification struct<country_registered:string,place_registered:string,registration_number:string>
"""
# Places of registration that mean the United Kingdom register.
UK_PLACES = ("united kingdom", "england", "wales", "scotland", "northern ireland", "great britain", "uk", "companies house")
UK_PAGE = "https://find-and-update.company-information.service.gov.uk/company/"


def uk_companies(companies: DataFrame) -> DataFrame:
    address = [
        f"registered_office_address.{part}"
        for part in ("po_box", "premises", "address_line_1", "address_line_2", "locality", "region", "postal_code")
    ]
    names = F.col("previous_company_names")
    return as_contract(
        companies.select(
            F.concat(F.lit("gb:"), "company_number").alias("company_id"),
            F.lit("GB").alias("jurisdiction"),
            F.coalesce(F.nullif(F.col("company_name"), F.lit("")), "title").alias("name"),
            F.col("company_status").alias("status"),
            day("date_of_creation").alias("incorporation_date"),
            day("date_of_cessation").alias("dissolution_date"),
            joined(*address, separator=", ").alias("registered_address"),
            F.when(names.isNotNull(), F.size(names)).alias("previous_name_count"),
            F.concat(F.lit(UK_PAGE), "company_number").alias("source_url"),
        ),
        "companies",
    )


def uk_officers(officers: DataFrame) -> DataFrame:
    """The officer id is the middle part of /officers/<id>/appointments."""
    link = F.regexp_extract(
        F.coalesce("links.officer.appointments", F.lit("")), "^/*officers/([^/]+)/[^/]+/*$", 1
    )
    return as_contract(
        officers.select(
            F.concat(F.lit("gb:"), "company_number").alias("company_id"),
            F.nullif(link, F.lit("")).alias("officer_id"),
            "name",
            "company_name",
            F.col("officer_role").alias("role"),
            day("appointed_on").alias("appointed_on"),
            day("resigned_on").alias("resigned_on"),
        ),
        "company_officers",
    )


def uk_controllers(controllers: DataFrame) -> DataFrame:
    """Persons with control; a protected person is a statement, a UK company resolves to its own id."""
    kind = F.coalesce("kind", F.lit(""))
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("description"), F.lit("")), kind)
    protected, person = kind.startswith("super-secure"), kind.startswith("individual")
    born = F.when(
        (F.col("date_of_birth.year") > 0) & (F.col("date_of_birth.month") > 0),
        F.format_string("|%d-%02d", F.col("date_of_birth.year"), F.col("date_of_birth.month")),
    )
    where = F.lower(
        F.concat_ws(
            " ",
            F.coalesce("identification.country_registered", F.lit("")),
            F.coalesce("identification.place_registered", F.lit("")),
        )
    )
    in_uk = F.exists(F.array(*[F.lit(place) for place in UK_PLACES]), lambda place: where.contains(place))
    number = F.replace(
        F.upper(F.trim(F.coalesce("identification.registration_number", F.lit("")))), F.lit(" "), F.lit("")
    )
    padded = F.when(number.rlike("^[0-9]+$") & (F.length(number) < 8), F.lpad(number, 8, "0")).otherwise(number)
    named_id = F.concat(F.lit("gb:psc:"), F.upper(name))
    return as_contract(
        controllers.select(
            F.concat(F.lit("gb:"), "company_number").alias("company_id"),
            F.when(protected, F.concat(F.lit("gb:statement:"), kind))
            .when(person, F.concat(named_id, F.coalesce(born, F.lit(""))))
            .otherwise(named_id)
            .alias("controller_id"),
            name.alias("controller_name"),
            F.when(protected, "statement").when(person, "individual").otherwise("legal_entity").alias("controller_kind"),
            F.when(protected, F.lit(None))
            .when(person, F.col("country_of_residence"))
            .otherwise(F.col("identification.country_registered"))
            .alias("controller_country"),
            F.when(~protected & ~person & in_uk & (number != ""), F.concat(F.lit("gb:"), padded)).alias(
                "controller_company_id"
            ),
            F.when(protected, kind)
            .otherwise(F.nullif(F.array_join("natures_of_control", "|"), F.lit("")))
            .alias("control_type"),
            day("notified_on").alias("notified_on"),
            day("ceased_on").alias("ceased_on"),
        ),
        "company_controllers",
    )


_LEI_ENTITY = """struct<jurisdiction:string,status:string,creationDate:string,legalName:struct<name:string>,
    expiration:struct<reason:string,date:string>,
    legalAddress:struct<addressLines:array<string>,postalCode:string,city:string,country:string>>"""
LEI_RECORD = f"attributes struct<lei:string,entity:{_LEI_ENTITY}>, links struct<self:string>"
LEI_PARENT = f"""
    lei string, level string, data struct<attributes:struct<lei:string,entity:{_LEI_ENTITY}>>
"""


def _lei_country(entity: str) -> Column:
    """Country of the jurisdiction (US-DE -> US), else of the legal address."""
    place = F.coalesce(
        F.nullif(F.col(f"{entity}.jurisdiction"), F.lit("")), F.nullif(F.col(f"{entity}.legalAddress.country"), F.lit(""))
    )
    return F.upper(F.get(F.split(place, "-"), 0))


def lei_companies(records: DataFrame) -> DataFrame:
    entity = "attributes.entity"
    lines = F.filter(
        F.concat(
            F.coalesce(f"{entity}.legalAddress.addressLines", F.array().cast("array<string>")),
            F.array(f"{entity}.legalAddress.postalCode", f"{entity}.legalAddress.city"),
        ),
        lambda part: F.coalesce(part, F.lit("")) != "",
    )
    return as_contract(
        records.select(
            F.concat(F.lit("lei:"), "attributes.lei").alias("company_id"),
            _lei_country(entity).alias("jurisdiction"),
            F.col(f"{entity}.legalName.name").alias("name"),
            F.col(f"{entity}.status").alias("status"),
            day(f"{entity}.creationDate").alias("incorporation_date"),
            F.when(F.col(f"{entity}.expiration.reason") == "DISSOLVED", day(f"{entity}.expiration.date")).alias(
                "dissolution_date"
            ),
            F.nullif(F.array_join(lines, ", "), F.lit("")).alias("registered_address"),
            F.col("links.self").alias("source_url"),
        ),
        "companies",
    )


def lei_controllers(parents: DataFrame) -> DataFrame:
    """Direct and ultimate parents; one that is both is kept once, as the direct parent."""
    entity = "data.attributes.entity"
    parent = F.concat(F.lit("lei:"), "data.attributes.lei")
    rows = (
        parents.filter("data.attributes.lei <> ''")
        .select(
            F.concat(F.lit("lei:"), "lei").alias("company_id"),
            parent.alias("controller_id"),
            F.col(f"{entity}.legalName.name").alias("controller_name"),
            _lei_country(entity).alias("controller_country"),
            F.col("level").alias("control_type"),
        )
        .groupBy("company_id", "controller_id")
        .agg(
            # 'direct-parent' comes before 'ultimate-parent'.
            F.min_by(F.struct("controller_name", "controller_country"), "control_type").alias("kept"),
            F.min("control_type").alias("control_type"),
        )
    )
    return as_contract(
        rows.select(
            "company_id",
            "controller_id",
            "kept.controller_name",
            F.lit("legal_entity").alias("controller_kind"),
            "kept.controller_country",
            F.col("controller_id").alias("controller_company_id"),
            "control_type",
        ),
        "company_controllers",
    )


NO_ENTITY = """
    organisasjonsnummer string, navn string, konkurs boolean, underAvvikling boolean,
    underTvangsavviklingEllerTvangsopplosning boolean, stiftelsesdato string,
    registreringsdatoEnhetsregisteret string, historiskeNavn array<struct<navn:string>>,
    forretningsadresse struct<adresse:array<string>,postnummer:string,poststed:string>,
    _links struct<self:struct<href:string>>
"""
NO_ROLES = """
    organisasjonsnummer string,
    rollegrupper array<struct<roller:array<struct<avregistrert:boolean,type:struct<kode:string>,
        person:struct<fodselsdato:string,navn:struct<fornavn:string,mellomnavn:string,etternavn:string>>,
        enhet:struct<organisasjonsnummer:string,navn:array<string>>>>>>
"""


def no_companies(entities: DataFrame) -> DataFrame:
    def flag(name: str) -> Column:
        return F.coalesce(name, F.lit(False))

    place = joined("forretningsadresse.postnummer", "forretningsadresse.poststed")
    address = F.concat(
        F.coalesce("forretningsadresse.adresse", F.array().cast("array<string>")),
        F.when(place.isNotNull(), F.array(place)).otherwise(F.array().cast("array<string>")),
    )
    return as_contract(
        entities.select(
            F.concat(F.lit("no:"), "organisasjonsnummer").alias("company_id"),
            F.lit("NO").alias("jurisdiction"),
            F.col("navn").alias("name"),
            F.when(flag("konkurs"), "bankrupt")
            .when(flag("underAvvikling") | flag("underTvangsavviklingEllerTvangsopplosning"), "in_liquidation")
            .otherwise("active")
            .alias("status"),
            day(F.coalesce(F.nullif(F.col("stiftelsesdato"), F.lit("")), "registreringsdatoEnhetsregisteret")).alias(
                "incorporation_date"
            ),
            F.nullif(F.array_join(address, ", "), F.lit("")).alias("registered_address"),
            F.coalesce(F.size("historiskeNavn"), F.lit(0)).alias("previous_name_count"),
            F.col("_links.self.href").alias("source_url"),
        ),
        "companies",
    )


def no_officers(roles: DataFrame) -> DataFrame:
    """Current roles; a role is held by an entity or by a person known by name and birth date."""
    held = (
        roles.select("organisasjonsnummer", F.explode("rollegrupper").alias("g"))
        .select("organisasjonsnummer", F.explode("g.roller").alias("r"))
        .filter(~F.coalesce("r.avregistrert", F.lit(False)))
    )
    is_entity = F.coalesce("r.enhet.organisasjonsnummer", F.lit("")) != ""
    person = F.coalesce(
        joined("r.person.navn.fornavn", "r.person.navn.mellomnavn", "r.person.navn.etternavn"), F.lit("")
    )
    return as_contract(
        held.select(
            F.concat(F.lit("no:"), "organisasjonsnummer").alias("company_id"),
            F.when(is_entity, F.concat(F.lit("no:"), "r.enhet.organisasjonsnummer"))
            .otherwise(
                F.concat(
                    F.lit("no:person:"), F.upper(person), F.lit("|"), F.coalesce("r.person.fodselsdato", F.lit(""))
                )
            )
            .alias("officer_id"),
            F.when(is_entity, F.coalesce(F.array_join("r.enhet.navn", " "), F.lit(""))).otherwise(person).alias("name"),
            F.col("r.type.kode").alias("role"),
        ),
        "company_officers",
    )
