"""Procurement: OCDS releases and US federal awards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.sources.landed.common import as_contract, day, items

_VALUE = "struct<amount:double,amountGross:double,currency:string>"
_CLASS = "struct<scheme:string,id:string>"
_ITEM = f"struct<classification:{_CLASS},additionalClassifications:array<{_CLASS}>>"
_LOT = f"struct<id:string,value:{_VALUE}>"
_SUPPLIER = "struct<id:string,name:string>"
RELEASE = f"""
    id string, ocid string, date string, tag array<string>, buyer struct<id:string,name:string>,
    tender struct<procurementMethod:string,classification:{_CLASS},items:array<{_ITEM}>,value:{_VALUE},
        lots:array<{_LOT}>,tenderPeriod:struct<startDate:string,endDate:string>,numberOfTenderers:bigint>,
    awards array<struct<id:string,date:string,value:{_VALUE},relatedLots:array<string>,
        suppliers:array<{_SUPPLIER}>,items:array<{_ITEM}>>>,
    contracts array<struct<awardID:string,value:{_VALUE},dateSigned:string>>,
    bids struct<statistics:array<struct<measure:string,value:bigint,relatedLot:string>>>
"""


def _amount(value: Column) -> Column:
    return F.coalesce(value["amount"], value["amountGross"])


def _tagged(tag: str) -> Column:
    return F.coalesce(F.array_contains("tag", tag), F.lit(False))


def _lot_ids() -> Column:
    known = F.filter(F.col("tender.lots.id"), lambda lot: lot.isNotNull())
    return F.coalesce(known, F.array().cast("array<string>"))


def _process_id(lot: Column) -> Column:
    return F.when(
        lot.isNotNull() & F.coalesce(F.array_contains(_lot_ids(), lot), F.lit(False)),
        F.concat_ws("/", F.col("ocid"), lot),
    ).otherwise(F.col("ocid"))


def _category() -> Column:
    """The tender's code, else the first CPV code of the tender's items, then of the awards' items."""
    no_items = F.array().cast(f"array<{_ITEM}>")
    every_item = F.concat(
        F.coalesce("tender.items", no_items),
        F.flatten(F.transform(F.coalesce("awards.items", F.array(no_items)), lambda found: F.coalesce(found, no_items))),
    )
    codes = F.flatten(
        F.transform(
            every_item,
            lambda item: F.concat(
                F.array(item["classification"]),
                F.coalesce(item["additionalClassifications"], F.array().cast(f"array<{_CLASS}>")),
            ),
        )
    )
    cpv = F.filter(codes, lambda code: (code["scheme"] == "CPV") & (F.coalesce(code["id"], F.lit("")) != ""))
    return F.coalesce(F.nullif(F.col("tender.classification.id"), F.lit("")), F.get(cpv, 0)["id"])


def ocds_processes(releases: DataFrame) -> DataFrame:
    """One row per lot. Contract-stage releases describe no process and give no row."""
    describes = (
        F.col("tender.procurementMethod").isNotNull()
        | (F.coalesce(F.size("tender.lots"), F.lit(0)) > 0)
        | F.col("tender.tenderPeriod").isNotNull()
    )
    lot_id = F.col("lot.id")
    for_lot = F.filter(
        F.coalesce(
            "bids.statistics",
            F.array().cast("array<struct<measure:string,value:bigint,relatedLot:string>>"),
        ),
        lambda stat: (stat["measure"] == "bids")
        & F.when(stat["relatedLot"].isNotNull(), stat["relatedLot"].eqNullSafe(lot_id)).otherwise(
            F.size(_lot_ids()) <= 1
        ),
    )
    bids = F.when(F.size(for_lot) > 0, F.get(for_lot, 0)["value"]).otherwise(F.col("tender.numberOfTenderers"))
    value = F.coalesce("lot.value", "tender.value")
    published = F.coalesce(F.nullif(F.col("tender.tenderPeriod.startDate"), F.lit("")), F.when(_tagged("tender"), F.col("date")))
    return as_contract(
        releases.filter(describes)
        .withColumn("lot", F.explode(items("tender.lots", _LOT)))
        .select(
            _process_id(lot_id).alias("process_id"),
            F.col("buyer.id").alias("buyer_id"),
            F.col("buyer.name").alias("buyer_name"),
            F.lit("GB").alias("country"),
            _category().alias("category_code"),
            F.col("tender.procurementMethod").alias("procurement_method"),
            _amount(value).alias("tender_value"),
            value["currency"].alias("currency"),
            day(published).alias("tender_published_date"),
            day("tender.tenderPeriod.endDate").alias("tender_deadline"),
            bids.alias("number_of_tenderers"),
        ),
        "procurement_processes",
    )


def ocds_awards(releases: DataFrame) -> DataFrame:
    """One row per award and supplier, and one row with only the final value per amended contract."""
    contract_type = f"struct<awardID:string,value:{_VALUE},dateSigned:string>"
    signed = F.filter(
        F.coalesce("contracts", F.array().cast(f"array<{contract_type}>")),
        lambda contract: F.coalesce(contract["awardID"], F.lit("None")) == F.coalesce("award.id", F.lit("None")),
    )
    amounts = F.filter(F.transform(signed, lambda c: _amount(c["value"])), lambda amount: amount.isNotNull())
    total = F.when(F.size(amounts) > 0, F.aggregate(amounts, F.lit(0.0), lambda running, amount: running + amount))
    currencies = F.filter(F.transform(signed, lambda c: c["value"]["currency"]), lambda code: code.isNotNull())
    own = _amount(F.col("award.value"))
    from_contracts = own.isNull() & (F.size(signed) > 0)
    dates = F.filter(
        F.concat(F.array("award.date"), F.transform(signed, lambda c: c["dateSigned"]), F.array("date")),
        lambda value: F.coalesce(value, F.lit("")) != "",
    )
    awarded = (
        releases.withColumn("award", F.explode("awards"))
        .withColumn("supplier", F.explode(items("award.suppliers", _SUPPLIER)))
        .select(
            F.concat("ocid", F.lit("/"), F.coalesce("award.id", F.lit("None"))).alias("award_id"),
            _process_id(F.get("award.relatedLots", 0)).alias("process_id"),
            F.col("supplier.id").alias("supplier_id"),
            F.col("supplier.name").alias("supplier_name"),
            F.when(from_contracts, total).otherwise(own).alias("award_value"),
            F.when(from_contracts, F.get(currencies, 0)).otherwise(F.col("award.value.currency")).alias("currency"),
            day(F.get(dates, 0)).alias("award_date"),
        )
    )
    amended = (
        releases.filter(_tagged("contractAmendment"))
        .withColumn("contract", F.explode("contracts"))
        .select(
            F.concat("ocid", F.lit("/"), F.coalesce("contract.awardID", F.lit("None"))).alias("award_id"),
            F.col("contract.value.currency").alias("currency"),
            _amount(F.col("contract.value")).alias("final_value"),
        )
    )
    return as_contract(awarded, "procurement_awards").unionByName(as_contract(amended, "procurement_awards"))


US_AWARD = """
    generated_internal_id string, `Awarding Sub Agency` string, `Recipient UEI` string, `Recipient Name` string,
    `Base Obligation Date` string
"""
US_AWARD_DETAIL = """
    generated_internal_id string, total_obligation double, date_signed string,
    awarding_agency struct<subtier_agency:struct<code:string,name:string>>,
    recipient struct<recipient_uei:string,recipient_name:string>,
    latest_transaction_contract_data struct<extent_competed:string,naics:string,number_of_offers_received:string>
"""
# Extent competed -> procurement method.
US_METHODS = {
    "A": "open",
    "D": "selective",
    "CDO": "selective",
    "F": "limited",
    "B": "direct",
    "C": "direct",
    "E": "direct",
    "G": "direct",
    "NDO": "direct",
}


def _us_joined(awards: DataFrame, details: DataFrame) -> DataFrame:
    return awards.join(details, "generated_internal_id", "left")


def us_processes(awards: DataFrame, details: DataFrame) -> DataFrame:
    contract = F.col("latest_transaction_contract_data")
    method = F.create_map(*[F.lit(item) for pair in US_METHODS.items() for item in pair])
    return as_contract(
        _us_joined(awards, details).select(
            F.col("generated_internal_id").alias("process_id"),
            F.col("awarding_agency.subtier_agency.code").alias("buyer_id"),
            F.coalesce(
                F.nullif(F.col("awarding_agency.subtier_agency.name"), F.lit("")), F.col("`Awarding Sub Agency`")
            ).alias("buyer_name"),
            F.lit("US").alias("country"),
            contract["naics"].alias("category_code"),
            F.try_element_at(method, contract["extent_competed"]).alias("procurement_method"),
            F.lit("USD").alias("currency"),
            contract["number_of_offers_received"].try_cast("long").alias("number_of_tenderers"),
        ),
        "procurement_processes",
    )


def us_awards(awards: DataFrame, details: DataFrame) -> DataFrame:
    """Current award values; the source has no value at award, so no final value either."""
    return as_contract(
        _us_joined(awards, details).select(
            F.col("generated_internal_id").alias("award_id"),
            F.col("generated_internal_id").alias("process_id"),
            F.coalesce(F.nullif(F.col("recipient.recipient_uei"), F.lit("")), F.col("`Recipient UEI`")).alias("supplier_id"),
            F.coalesce(F.nullif(F.col("recipient.recipient_name"), F.lit("")), F.col("`Recipient Name`")).alias("supplier_name"),
            F.col("total_obligation").alias("award_value"),
            F.lit("USD").alias("currency"),
            day(F.coalesce(F.nullif(F.col("date_signed"), F.lit("")), F.col("`Base Obligation Date`"))).alias("award_date"),
        ),
        "procurement_awards",
    )
