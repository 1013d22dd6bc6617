"""The released detectors, and running several of them over one set of tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from inspect import signature

from pyspark.sql import DataFrame, SparkSession

from leadspark.functions import checks
from leadspark.operators import (
    campaign_finance,
    companies,
    court,
    lobbying,
    networks,
    parliamentary,
    procurement,
    sequences,
    statistical,
)
from leadspark.sources.contracts import contract_schema, load_contract, map_roles


class RequestError(ValueError):
    """A detector request does not fit the registry or the supplied tables."""


@dataclass(frozen=True)
class Detector:
    """A detector function with what a caller needs to run it and to describe its leads.

    ``tables`` names contract tables; a detector without any reads one table
    whose columns are mapped to ``roles``.
    """

    id: str
    run: Callable[..., DataFrame]
    title: str
    description: str
    category: str
    severity: str
    tables: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    types: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    minimum_coverage: Mapping[str, float] = field(default_factory=dict)
    relevance: float = 0.0
    utility: float = 0.0
    cost: float = 0.0
    false_positive_risk: float = 0.0
    redact: bool = True
    version: str = "1.0.0"
    assumptions: tuple[str, ...] = ()
    false_positives: tuple[str, ...] = ()

    @property
    def family(self) -> str:
        return self.id.split(".", 1)[0]

    @property
    def group(self) -> str:
        """Detectors of one group are spread when detectors are recommended."""
        return "domain" if self.tables else self.family


# Accepted types per role of the statistical detectors.
_ROLE_TYPES = {
    "id": ("integer", "text"),
    "observed_at": ("datetime",),
    "amount": ("integer", "float"),
    "group": ("text",),
}


def _any_table(id: str, run: Callable[..., DataFrame], roles: str, title: str, description: str) -> Detector:
    names = tuple(roles.split())
    return Detector(
        id=id,
        run=run,
        title=title,
        description=description,
        category="statistical",
        severity="medium",
        roles=names,
        version="1.1.0",
        types={name: _ROLE_TYPES[name] for name in names},
        minimum_coverage={name: 0.75 for name in names},
        relevance=0.8,
        utility=0.7,
        cost=0.2,
        false_positive_risk=0.1,
    )


def _domain(
    id: str, run: Callable[..., DataFrame], tables: str, severity: str, title: str, description: str, **extra
) -> Detector:
    return Detector(
        id=id,
        run=run,
        title=title,
        description=description,
        category=id.split(".", 1)[0],
        severity=severity,
        tables=tuple(tables.split()),
        **extra,
    )


_VOTE_TABLES = "parl_members parl_votings parl_member_votes"
_AWARD_TABLES = "procurement_processes procurement_awards"

RELEASED: tuple[Detector, ...] = (
    _any_table(
        "numeric.zscore_outliers", statistical.zscore_outliers, "id amount",
        "Z-score outliers", "Amounts far from the mean of all other amounts.",
    ),
    _any_table(
        "numeric.level_shift", statistical.level_shift, "id observed_at amount",
        "Numeric level shift", "Amounts far from the mean of the observations just before them.",
    ),
    _any_table(
        "temporal.coverage_gaps", statistical.coverage_gaps, "id observed_at",
        "Temporal coverage gaps", "Gaps between consecutive observations.",
    ),
    _any_table(
        "categorical.rare_levels", statistical.rare_levels, "group",
        "Rare categorical levels", "Values that occur unusually seldom.",
    ),
    _any_table(
        "table.duplicate_rows", statistical.duplicate_rows, "id",
        "Duplicate rows", "Records that occur more than once.",
    ),
    _any_table(
        "table.missingness_clusters", statistical.missingness_clusters, "group amount",
        "Missingness clusters", "Groups in which amounts go missing together.",
    ),
    _domain(
        "campaign_finance.maxed_donor_clusters", campaign_finance.maxed_donor_clusters, "donations", "medium",
        "Maxed donor clusters", "Donors with one employer or postcode who give near the limit within a few days.",
    ),
    _domain(
        "campaign_finance.new_recipient_single_funder", campaign_finance.new_recipient_single_funder,
        "donations recipients", "high",
        "New recipient, single funder", "A new recipient with nearly all early money from one donor.",
    ),
    _domain(
        "campaign_finance.structured_gifts", campaign_finance.structured_gifts, "donations", "medium",
        "Structured gifts", "Gifts under a threshold that together reach it.",
    ),
    _domain(
        "companies.circular_control", companies.circular_control, "company_controllers", "high",
        "Circular control", "Companies that control themselves through other companies.",
    ),
    _domain(
        "companies.frequent_name_changes", companies.frequent_name_changes, "companies", "low",
        "Frequent name changes", "Companies that changed their name many times.",
    ),
    _domain(
        "companies.prolific_officer", companies.prolific_officer, "company_officers company_controllers", "medium",
        "Prolific officer or controller", "One officer or controller in very many companies.",
    ),
    _domain(
        "companies.rapid_dissolution", companies.rapid_dissolution, "companies", "low",
        "Rapid incorporation and dissolution", "Companies dissolved soon after incorporation.",
    ),
    _domain(
        "companies.secrecy_jurisdiction_controller", companies.secrecy_jurisdiction_controller,
        "company_controllers companies", "medium",
        "Controller in a secrecy jurisdiction", "Companies controlled from another, secretive country.",
    ),
    _domain(
        "companies.shared_registered_address", companies.shared_registered_address, "companies", "medium",
        "Mass registration address", "Addresses shared by many companies.",
    ),
    _domain(
        "court.gift_from_litigant_or_counsel", court.gift_from_litigant_or_counsel,
        "court_cases case_parties case_counsel judge_interests", "high",
        "Gift or paid trip from a litigant or counsel", "Gifts to a judge from someone in one of their cases.",
    ),
    _domain(
        "court.judge_holds_party_stock", court.judge_holds_party_stock,
        "court_cases case_parties judge_interests", "high",
        "Judge holds stock in a party", "Cases of a judge with an investment in a party.",
    ),
    _domain(
        "court.long_pending_cases", court.long_pending_cases, "court_cases", "low",
        "Long-pending cases", "Cases still open many years after filing.", redact=False,
    ),
    _domain(
        "court.repeat_party_before_judge", court.repeat_party_before_judge, "court_cases case_parties", "medium",
        "Repeat party before the same judge", "Parties whose cases nearly all went to one judge.",
    ),
    _domain(
        "court.single_judge_concentration", court.single_judge_concentration, "court_cases", "medium",
        "Cases concentrated on one judge", "Courts in which one judge gets nearly all cases of a kind.", redact=False,
    ),
    _domain(
        "lobbying.spending_spikes", lobbying.spending_spikes, "lobbying_registrations", "medium",
        "Spending spikes", "Spend that jumps against the previous four periods.", version="2.0.0",
    ),
    _domain(
        "lobbying.missing_spend_filings", lobbying.missing_spend_filings, "lobbying_registrations", "medium",
        "Missing spend filings", "Repeated reports without the money such reports carry.", version="2.0.0",
    ),
    _domain(
        "lobbying.revolving_door_candidates", lobbying.revolving_door_candidates,
        "lobbyists lobbying_registrations", "medium",
        "Revolving door candidates", "Lobbyists with a former public office.", version="2.0.0",
    ),
    _domain(
        "lobbying.foreign_filings", lobbying.foreign_filings,
        "lobbying_registrations lobbying_foreign_entities", "medium",
        "Foreign filings", "Filings that list foreign entities.", version="2.0.0",
    ),
    _domain(
        "lobbying.single_client_juggernauts", lobbying.single_client_juggernauts, "lobbying_registrations", "medium",
        "Single client juggernauts", "Consultants with one or two clients and a high spend.", version="2.0.0",
    ),
    _domain(
        "lobbying.pac_contribution_flow", lobbying.pac_contribution_flow, "political_contributions", "medium",
        "PAC contribution flow", "Contributions per payee and honoree.", version="2.0.0",
    ),
    _domain(
        "lobbying.issue_concentration_shifts", lobbying.issue_concentration_shifts,
        "lobbying_registrations", "medium",
        "Issue concentration shifts", "Shifts of spend per issue between quarters.", version="2.0.0",
    ),
    _domain(
        "lobbying.new_registrant_surge", lobbying.new_registrant_surge, "lobbying_registrations", "medium",
        "New registrant surge", "Registrants first seen in the latest days.", version="2.0.0",
    ),
    _domain(
        "lobbying.shell_pattern_filings", lobbying.shell_pattern_filings,
        "lobbyists lobbying_registrations lobbying_activities", "medium",
        "Shell pattern filings", "Filings with text signs of a shell client.", version="2.0.0",
    ),
    _domain(
        "lobbying.fara_gap_narrowed", lobbying.fara_gap_narrowed,
        "lobbying_registrations lobbying_foreign_entities lobbying_activities foreign_agent_registrants", "medium",
        "FARA gap narrowed", "Foreign interest filings by a registrant missing from the agent list.",
        version="2.0.0",
    ),
    _domain(
        "lobbying.revolving_door_committee_match", lobbying.revolving_door_committee_match,
        "lobbyists lobbying_registrations lobbying_activities", "medium",
        "Revolving door committee match", "Lobbyists on the issues of their former committee.", version="2.0.0",
    ),
    _domain(
        "lobbying.committee_say_vs_pay", lobbying.committee_say_vs_pay,
        "lobbyists lobbying_registrations committee_assignments legislators press_releases", "medium",
        "Committee say vs pay", "Lobbying by former committee staff next to the members' statements.",
        version="2.0.0",
    ),
    _domain(
        "lobbying.foreign_clients", lobbying.foreign_clients, "lobbying_registrations", "medium",
        "Foreign clients", "Interests from outside the register's home countries.", version="2.0.0",
    ),
    _domain(
        "lobbying.former_official_lobbies_former_institution", lobbying.former_official_lobbies_former_institution,
        "lobbyists lobbying_registrations lobbying_contacts", "medium",
        "Former official lobbies former institution", "Contacts with a lobbyist's former institution.",
        version="2.0.0",
    ),
    _domain(
        "lobbying.contact_bursts", lobbying.contact_bursts, "lobbying_contacts", "medium",
        "Contact bursts", "Months with unusually many contacts.", version="2.0.0",
    ),
    _domain(
        "parliamentary.absence_outlier", parliamentary.absence_outlier, _VOTE_TABLES, "low",
        "Absence outlier", "Members absent far more often than the median member.",
    ),
    _domain(
        "parliamentary.group_rebellion_rate", parliamentary.group_rebellion_rate, _VOTE_TABLES, "low",
        "Group rebellion rate", "Members who often vote against their group.",
    ),
    _domain(
        "parliamentary.rebellion_rise", parliamentary.rebellion_rise, _VOTE_TABLES, "low",
        "Rebellion rise", "Members who suddenly vote against their group more often.",
    ),
    _domain(
        "parliamentary.group_switch", parliamentary.group_switch, "parl_members parl_affiliations", "low",
        "Group switch", "Members who moved to another group within a term.",
    ),
    _domain(
        "parliamentary.outside_interests_load", parliamentary.outside_interests_load,
        "parl_members parl_interests", "low",
        "Outside interests load", "Members with many paid mandates or a high outside income.",
    ),
    _domain(
        "procurement.single_bid_competitive", procurement.single_bid_competitive, "procurement_processes", "medium",
        "Single bid in a competitive procedure", "Competitive processes with one bid.",
    ),
    _domain(
        "procurement.short_submission_period", procurement.short_submission_period, "procurement_processes", "medium",
        "Short submission period", "Competitive processes that left bidders few days.",
    ),
    _domain(
        "procurement.non_open_procedure_share", procurement.non_open_procedure_share,
        "procurement_processes", "medium",
        "High share of non-open procedures", "Buyers with many limited or direct procedures.",
    ),
    _domain(
        "procurement.supplier_share_outlier", procurement.supplier_share_outlier, _AWARD_TABLES, "medium",
        "Supplier share outlier", "Suppliers with a high share of a buyer's awards.",
    ),
    _domain(
        "procurement.value_growth_after_award", procurement.value_growth_after_award, _AWARD_TABLES, "medium",
        "Value growth after award", "Awards whose final value far exceeds the award.",
    ),
)

def _draft(id: str, run: Callable[..., DataFrame], roles: str, title: str, description: str) -> Detector:
    names = tuple(roles.split())
    return Detector(
        id=id, run=run, title=title, description=description, category=id.split(".", 1)[0], severity="medium", roles=names
    )


# Detectors with own definitions: they run by id, but are not matched with tables or recommended.
DRAFTS: tuple[Detector, ...] = (
    _draft(
        "network.cross_commit_overlap", networks.cross_commit_overlap, "member entity",
        "Cross-commit overlap", "Members that share several entities.",
    ),
    _draft(
        "text.portfolio_cloning", networks.portfolio_cloning, "member entity",
        "Portfolio cloning", "Members with nearly the same portfolio.",
    ),
    _draft(
        "relational.shared_identifiers", networks.shared_identifiers, "entity kind identifier",
        "Shared identifiers", "Entities connected by identifiers, with the chain that connects them.",
    ),
    _draft(
        "network.shared_infrastructure", networks.shared_infrastructure, "entity kind identifier",
        "Shared infrastructure", "Identifiers that several entities use.",
    ),
    _draft(
        "temporal.backdated_records", sequences.backdated_records, "id entity sequence observed_at",
        "Backdated records", "Records dated before records with smaller numbers.",
    ),
    _draft(
        "temporal.timezone_activity_shifts", sequences.timezone_activity_shifts, "entity observed_at",
        "Activity shifts", "Entities whose usual hour of activity moves.",
    ),
)

_REGISTRY: dict[str, Detector] = {detector.id: detector for detector in RELEASED}
_DRAFTS: dict[str, Detector] = {draft.id: draft for draft in DRAFTS}


def detectors() -> dict[str, Detector]:
    return dict(_REGISTRY)


def detector(id: str) -> Detector:
    try:
        return _REGISTRY.get(id) or _DRAFTS[id]
    except KeyError:
        raise RequestError(f"no detector named {id}") from None


def register_detector(
    id: str,
    run: Callable[..., DataFrame] | str,
    *,
    tables: Sequence[str] = (),
    roles: Sequence[str] = (),
    title: str = "",
    description: str = "",
    category: str = "user",
    severity: str = "medium",
    redact: bool = True,
) -> Detector:
    """Add a caller's detector: a function of DataFrames, or SQL text for ``spark.sql``.

    SQL names its tables in braces, ``{donations}``; a detector over mapped
    columns reads ``{table}``. Parameters are named markers (``:minimum``).
    """
    if id in _REGISTRY or id in _DRAFTS:
        raise RequestError(f"a detector named {id} exists")
    if bool(tables) == bool(roles):
        raise RequestError("a detector reads either contract tables or mapped roles")
    if isinstance(run, str):
        text, names = run, tuple(tables) or ("table",)

        def function(*frames: DataFrame, **parameters) -> DataFrame:
            session: SparkSession = frames[0].sparkSession
            return session.sql(text, args=parameters or None, **dict(zip(names, frames, strict=True)))
    else:
        function = run
    for table in tables:
        contract_schema(table)
    added = Detector(
        id=id,
        run=function,
        title=title or id,
        description=description,
        category=category,
        severity=severity,
        tables=tuple(tables),
        roles=tuple(roles),
        redact=redact,
    )
    _REGISTRY[id] = added
    return added


def unregister_detector(id: str) -> None:
    if any(released.id == id for released in RELEASED):
        raise RequestError("released detectors stay registered")
    _REGISTRY.pop(id, None)


def run_detector(
    id: str,
    tables: DataFrame | Mapping[str, DataFrame],
    *,
    fields: Mapping[str, str] | None = None,
    columns: Mapping[str, Mapping[str, str]] | None = None,
    parameters: Mapping[str, object] | None = None,
) -> DataFrame:
    """Rows of one detector, lazily, over a mapped table or contract tables."""
    chosen = detector(id)
    parameters = dict(parameters or {})
    if chosen.tables:
        if isinstance(tables, DataFrame):
            raise RequestError(f"{id} reads the tables {list(chosen.tables)}, not one table")
        absent = [name for name in chosen.tables if name not in tables]
        if absent:
            raise RequestError(f"missing tables for {id}: {absent}")
        if set(columns or {}) - set(chosen.tables):
            raise RequestError(f"columns may only name the tables of {id}")
        frames = [load_contract(tables[name], name, (columns or {}).get(name)) for name in chosen.tables]
        return chosen.run(*frames, **parameters)
    if not isinstance(tables, DataFrame):
        raise RequestError(f"{id} reads one table with mapped columns")
    return chosen.run(map_roles(tables, list(chosen.roles), fields or {}), **parameters)


def run_detectors(
    tables: DataFrame | Mapping[str, DataFrame],
    requests: Sequence[Mapping[str, object]],
    *,
    provenance: Mapping[str, str] | None = None,
    max_output_rows: int | None = None,
) -> DataFrame:
    """Leads of the requested detectors as one DataFrame.

    A request is ``{"id": …, "fields": …, "columns": …, "parameters": …}``.
    Spark runs the detectors as branches of a union. ``max_output_rows`` keeps
    the first rows of every detector in its own order (any rows of those that
    have none).
    """
    from leadspark.plans.leads import to_leads

    if not requests:
        raise RequestError("name at least one detector")
    ids = [str(request.get("id")) for request in requests]
    if len(set(ids)) != len(ids):
        raise RequestError("every detector may be named once per call")
    unknown = {key for request in requests for key in request} - {"id", "fields", "columns", "parameters"}
    if unknown:
        raise RequestError(f"unknown request keys: {sorted(unknown)}")
    if max_output_rows is not None:
        checks.at_least("max_output_rows", max_output_rows, 1)
    leads = []
    for request in requests:
        id = str(request["id"])
        parameters = dict(request.get("parameters") or {})
        if max_output_rows is not None and "limit" in signature(detector(id).run).parameters:
            parameters["limit"] = min(parameters.get("limit") or max_output_rows, max_output_rows)
        rows = run_detector(
            id, tables, fields=request.get("fields"), columns=request.get("columns"), parameters=parameters
        )
        if max_output_rows is not None:
            rows = rows.limit(max_output_rows)
        leads.append(to_leads(rows, detector(id), provenance=provenance))
    return reduce(DataFrame.unionByName, leads)
