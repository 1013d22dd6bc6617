"""Registered queries and reference SQL of the detectors with own definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.operators import networks, profiles, sequences
from leadspark.testbed.queries import Query, read, rounded


def _order_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their suppliers; a third of the orders have one supplier in common."""
    shared = (F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 3 == 0)
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("member"), F.when(shared, -1).otherwise(F.col("l_suppkey")).alias("entity")
    )


def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.cross_commit_overlap(_order_suppliers(spark, sf_dir), minimum_common=3)


def _cloning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(networks.portfolio_cloning(_order_suppliers(spark, sf_dir), minimum_similarity=0.7))


# One user has a third of all events; every 50th event is recorded three days early.
_ENTITY = "CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END"


def _backdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.expr(_ENTITY).alias("entity"),
        F.col("event_id").alias("sequence"),
        F.expr("CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL 3 DAYS ELSE ts END").alias("observed_at"),
    )
    return sequences.backdated_records(events, minimum_days=1)


# Users are active in their own three hours of the day; from the 16th on every tenth user six hours later.
_HOUR = "(user_id % 24 + event_id % 3 + CASE WHEN day(ts) >= 16 AND user_id % 10 = 0 THEN 6 ELSE 0 END) % 24"


def _activity_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"),
        F.expr(f"timestampadd(HOUR, CAST({_HOUR} AS INT), date_trunc('DAY', ts))").alias("observed_at"),
    )
    return rounded(sequences.timezone_activity_shifts(events, period="week", minimum_events=2))


_LATITUDE = "user_id % 60 + CASE WHEN event_id % 37 = 0 THEN 20 ELSE 0 END"


def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(
        F.expr(_ENTITY).alias("entity"),
        F.col("ts").alias("observed_at"),
        F.expr(_LATITUDE).cast("double").alias("latitude"),
        (F.col("user_id") % 120).cast("double").alias("longitude"),
        "event_type",
    )
    viewed = F.col("event_type") == "view"
    return rounded(sequences.location_conflicts(events.filter(viewed).drop("event_type"), events.filter(~viewed).drop("event_type")))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(
        F.expr("CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END").alias("id"),
        F.concat(F.lit(" "), "l_returnflag").alias("flag"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_linestatus")).otherwise(F.col("l_linestatus")).alias("status"),
        F.when(F.col("l_linenumber") < 6, F.col("l_linenumber") % 3).alias("line"),
    )
    return rounded(profiles.conflicting_profiles(lines))


def _identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by rounded balance, by neighbourhood, and a third of the even ones by one office."""
    customers = read(spark, sf_dir, "customer")
    one = customers.select(F.col("c_custkey").alias("entity"), F.lit("balance").alias("kind"), F.floor("c_acctbal").cast("string").alias("identifier"))
    office = customers.filter("c_custkey % 6 = 0").select(F.col("c_custkey").alias("entity"), F.lit("office").alias("kind"), F.lit("Main").alias("identifier"))
    lane = customers.filter("c_custkey % 10 < 4").select(
        F.col("c_custkey").alias("entity"), F.lit("lane").alias("kind"), F.floor(F.col("c_custkey") / 10).cast("string").alias("identifier")
    )
    return one.unionByName(office).unionByName(lane)


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.shared_identifiers(_identifiers(spark, sf_dir), minimum_entities=2)


def _infrastructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.shared_infrastructure(_identifiers(spark, sf_dir), minimum_entities=3)


PATTERN_QUERIES: dict[str, Query] = {
    "network.cross_commit_overlap": _overlap,
    "text.portfolio_cloning": _cloning,
    "relational.shared_identifiers": _shared,
    "network.shared_infrastructure": _infrastructure,
    "temporal.backdated_records": _backdated,
    "temporal.timezone_activity_shifts": _activity_shifts,
    "cross_dataset.location_conflicts": _conflicts,
    "relational.conflicting_profiles": _profiles,
}

_SETS = """
WITH e AS (
    SELECT DISTINCT l_orderkey AS m, CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN -1 ELSE l_suppkey END AS x FROM lineitem
), s AS (SELECT m, count(*) AS n, list_sort(list(x)) AS xs FROM e GROUP BY m),
reps AS (SELECT min(m) AS m, n, count(*) AS copies FROM s GROUP BY xs, n),
r AS (SELECT e.m, e.x, reps.n, reps.copies FROM e JOIN reps ON reps.m = e.m),
met AS (
    SELECT a.m AS ma, b.m AS mb, a.n AS na, b.n AS nb, a.copies AS ca, b.copies AS cb, count(*) AS c
    FROM r a JOIN r b ON a.x = b.x AND a.m < b.m GROUP BY ALL
    UNION ALL SELECT m, m, n, n, copies, copies, n FROM reps WHERE copies > 1
)"""

_COLUMNS = """SELECT '{prefix}-' || ma || '-' || mb AS candidate_id, '{category}' AS category, 'medium' AS severity, ma AS member_id,
    mb AS other_id, ca AS members, cb AS others, na AS member_entities, nb AS other_entities, c AS common_entities"""

_IDENTIFIERS = """
WITH RECURSIVE ids AS (
    SELECT c_custkey AS entity, 'balance' AS kind, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS identifier FROM customer
    UNION ALL SELECT c_custkey, 'office', 'Main' FROM customer WHERE c_custkey % 6 = 0
    UNION ALL SELECT c_custkey, 'lane', CAST(c_custkey // 10 AS VARCHAR) FROM customer WHERE c_custkey % 10 < 4
)"""

# Longest chain that the reference SQL follows, level by level.
_LEVELS = 14


def _chains() -> str:
    """Levels of a breadth-first search from the smallest entity of each cluster."""
    levels = ["l0 AS (SELECT DISTINCT entity, root, CAST(entity AS VARCHAR) AS chain FROM rooted WHERE entity = root)"]
    done = "SELECT entity, root, 0 AS hops, chain FROM l0"
    seen = "SELECT entity FROM l0"
    for level in range(1, _LEVELS + 1):
        levels.append(
            f"l{level} AS (SELECT b.entity, min(p.root) AS root, min(p.chain || ' [' || b.kind || ' ' || b.identifier || '] ' || b.entity) AS chain "
            f"FROM l{level - 1} p JOIN s a ON a.entity = p.entity JOIN s b ON b.kind = a.kind AND b.identifier = a.identifier "
            f"WHERE b.entity NOT IN ({seen}) GROUP BY b.entity)"
        )
        done += f" UNION ALL SELECT entity, root, {level}, chain FROM l{level}"
        seen += f" UNION ALL SELECT entity FROM l{level}"
    return ",\n".join(levels) + f",\nfound AS ({done})"


PATTERN_ORACLES: dict[str, str] = {
    "relational.shared_identifiers": f"""{_IDENTIFIERS},
s AS (SELECT * FROM ids QUALIFY count(*) OVER (PARTITION BY kind, identifier) > 1),
reach(root, entity) AS (
    SELECT DISTINCT entity, entity FROM s
    UNION
    SELECT r.root, b.entity FROM reach r JOIN s a ON a.entity = r.entity
    JOIN s b ON b.kind = a.kind AND b.identifier = a.identifier WHERE b.entity > r.root
),
rooted AS (SELECT entity, min(root) AS root FROM reach GROUP BY entity),
{_chains()}
SELECT 'shared-' || f.entity AS candidate_id, 'network' AS category, 'medium' AS severity, f.root AS cluster_id, f.entity,
    n AS entities, f.hops, f.chain
FROM found f JOIN (SELECT root, count(*) AS n FROM found GROUP BY root) USING (root) WHERE n >= 2""",
    "network.shared_infrastructure": f"""{_IDENTIFIERS},
u AS (SELECT *, count(*) OVER (PARTITION BY kind, identifier) AS n FROM ids),
w AS (SELECT *, count(*) OVER (PARTITION BY entity) - 1 AS others FROM u WHERE n >= 3)
SELECT 'infrastructure-' || kind || '-' || identifier AS candidate_id, 'network' AS category, 'medium' AS severity, kind, identifier,
    count(*) AS entities, min(entity) AS first_entity, max(entity) AS last_entity, max(others) AS co_identifiers
FROM w GROUP BY kind, identifier""",
    "network.cross_commit_overlap": f"{_SETS} {_COLUMNS.format(prefix='overlap', category='network')} FROM met WHERE c >= 3",
    "text.portfolio_cloning": f"""{_SETS} {_COLUMNS.format(prefix='clone', category='text')},
    round(c / (na + nb - c) + 0.0000003, 4) AS similarity
FROM met WHERE 10 * c >= 7 * (na + nb - c)""",
    "temporal.backdated_records": f"""
WITH e AS (
    SELECT event_id AS id, {_ENTITY} AS entity, CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL 3 DAY ELSE ts END AS t FROM events
), w AS (
    SELECT *, max({{'t': t, 'i': id}}) OVER (PARTITION BY entity ORDER BY id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM e
)
SELECT 'row-' || id AS candidate_id, 'backdated' AS category, 'medium' AS severity, entity, id AS sequence, t AS observed_at,
    h.t AS latest_before, h.i AS latest_id, date_diff('day', t, h.t) AS days_back
FROM w WHERE t < h.t AND date_diff('day', t, h.t) >= 1""",
    "temporal.timezone_activity_shifts": f"""
WITH e AS (
    SELECT user_id AS entity, date_trunc('week', ts)::DATE AS p, 2 * pi() * ({_HOUR}) / 24 AS a FROM events
), s AS (
    SELECT entity, p, count(*) AS n, avg(sin(a)) AS y, avg(cos(a)) AS x FROM e GROUP BY ALL
), d AS (
    SELECT entity, p, n, CASE WHEN atan2(y, x) < 0 THEN 24 ELSE 0 END + atan2(y, x) * 12 / pi() AS hour, round(sqrt(x * x + y * y), 9) AS r
    FROM s WHERE n >= 2 AND sqrt(x * x + y * y) >= 0.3
), l AS (
    SELECT *, lag(p) OVER w AS pp, lag(n) OVER w AS pn, lag(hour) OVER w AS ph FROM d WINDOW w AS (PARTITION BY entity ORDER BY p)
), f AS (SELECT *, hour - ph + CASE WHEN hour - ph > 12 THEN -24 WHEN hour - ph <= -12 THEN 24 ELSE 0 END AS shift FROM l WHERE pp IS NOT NULL)
SELECT 'shift-' || entity || '-' || p AS candidate_id, 'activity-shift' AS category, 'medium' AS severity, entity, pp AS previous_period,
    p AS period_start, pn AS previous_events, n AS events, round(ph + 0.0000003, 4) AS previous_hour,
    round(hour + 0.0000003, 4) AS mean_hour, round(r + 0.0000003, 4) AS concentration, round(shift + 0.0000003, 4) AS shift_hours
FROM f WHERE abs(shift) >= 3""",
    "cross_dataset.location_conflicts": f"""
WITH e AS (
    SELECT DISTINCT {_ENTITY} AS entity, ts, ({_LATITUDE})::DOUBLE AS lat, (user_id % 120)::DOUBLE AS lon,
        CASE WHEN event_type = 'view' THEN 'first' ELSE 'second' END AS source
    FROM events
), l AS (
    SELECT *, lag(ts) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(source) OVER w AS ps
    FROM e WINDOW w AS (PARTITION BY entity ORDER BY ts, lat, lon, source)
), d AS (
    SELECT *, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - plat) / 2), 2)
            + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) AS km,
        (epoch_us(ts) - epoch_us(pt)) / 3600000000.0 AS hours
    FROM l WHERE pt IS NOT NULL
)
SELECT 'place-' || entity || '-' || epoch_us(ts) AS candidate_id, 'location-conflict' AS category, 'medium' AS severity, entity,
    pt AS previous_at, ts AS observed_at, ps AS previous_source, source, round(km + 0.0000003, 4) AS distance_km,
    round(hours + 0.0000003, 4) AS hours, round(CASE WHEN hours > 0 THEN km / hours END + 0.0000003, 4) AS speed_kmh
FROM d WHERE km >= 50 AND (hours = 0 OR km / hours > 900)""",
    "relational.conflicting_profiles": """
WITH t AS (
    SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey END AS id, lower(l_returnflag) AS flag, lower(l_linestatus) AS status,
        CASE WHEN l_linenumber < 6 THEN CAST(l_linenumber % 3 AS VARCHAR) END AS line
    FROM lineitem
), long AS (
    SELECT id, 'flag' AS attribute, flag AS value FROM t UNION ALL SELECT id, 'status', status FROM t
    UNION ALL SELECT id, 'line', line FROM t
), c AS (SELECT id, attribute, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL),
r AS (
    SELECT *, row_number() OVER (PARTITION BY id, attribute ORDER BY n DESC, value) AS nth, count(*) OVER (PARTITION BY id, attribute) AS d,
        sum(n) OVER (PARTITION BY id, attribute) AS total
    FROM c
)
SELECT 'profile-' || id || '-' || attribute AS candidate_id, 'conflict' AS category, 'medium' AS severity, id AS entity_id, attribute,
    d AS distinct_values, value AS majority_value, n AS support, CAST(total - n AS BIGINT) AS contradicting,
    round(n / total + 0.0000003, 4) AS support_share
FROM r WHERE nth = 1 AND d > 1""",
}
