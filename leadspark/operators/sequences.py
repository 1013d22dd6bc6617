"""Detectors over ordered records of an entity (own definitions of draft detectors)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions import checks
from leadspark.functions.ordered import day_number, with_highest_before, with_previous_row

EARTH_KM = 6371.0


def backdated_records(df: DataFrame, *, minimum_days: int = 1, partitions: int | None = None) -> DataFrame:
    """Records dated before a record of the same entity with a smaller sequence number.

    Reads id, entity, sequence and observed_at; rows without a sequence or time are left
    out, NULL entities are one entity. ``latest_before`` is the latest time among the
    earlier numbers and ``latest_id`` its record (the largest id of several); days are
    calendar days. Equal numbers say nothing about each other. An entity of any size
    is worked on in ranges of its sequence.
    """
    checks.integer("minimum_days", minimum_days, 0, 36_500)
    rows = df.select("id", "entity", "sequence", "observed_at").filter("sequence IS NOT NULL AND observed_at IS NOT NULL")
    # Of one number the earlier time first: what comes before a row then never has its number and a later time.
    latest = with_highest_before(
        rows, ["entity"], ["sequence", "observed_at", "id"], F.struct("observed_at", "id"), "_latest", partitions=partitions
    )
    days = F.datediff("_latest.observed_at", "observed_at").cast("long")
    return latest.filter((F.col("observed_at") < F.col("_latest.observed_at")) & (days >= minimum_days)).select(
        F.concat(F.lit("row-"), F.coalesce(F.col("id").cast("string"), F.lit("unknown"))).alias("candidate_id"),
        F.lit("backdated").alias("category"),
        F.lit("medium").alias("severity"),
        "entity",
        "sequence",
        "observed_at",
        F.col("_latest.observed_at").alias("latest_before"),
        F.col("_latest.id").alias("latest_id"),
        days.alias("days_back"),
    )


def timezone_activity_shifts(
    df: DataFrame,
    *,
    period: str = "month",
    minimum_events: int = 20,
    minimum_shift_hours: float = 3.0,
    minimum_concentration: float = 0.3,
) -> DataFrame:
    """Entities whose usual hour of activity moves between two periods.

    Reads entity and observed_at. An hour is a direction on a circle of 24, so 23:30
    and 00:30 are one hour apart. A period counts if it has enough events and they
    agree (the length of their mean direction, 0 to 1); each is compared with the
    entity's last such period before. Sums of sines and cosines are added up in tasks,
    one row for each entity and period is what windows see.
    """
    if period not in ("week", "month", "quarter"):
        raise checks.ParameterError("period must be week, month or quarter")
    checks.at_least("minimum_events", minimum_events, 1)
    checks.number("minimum_shift_hours", minimum_shift_hours, 0.01, 12.0)
    checks.number("minimum_concentration", minimum_concentration, 0.0, 1.0)
    timed = df.select("entity", "observed_at").filter("entity IS NOT NULL AND observed_at IS NOT NULL")
    # Whole hours are exact numbers here, and each step is rounded as in plain arithmetic on hours: a shift of exactly
    # the minimum is decided by the last digit.
    hours = (F.hour("observed_at") * 3600 + F.minute("observed_at") * 60 + F.second("observed_at")) / 3600
    turn = F.lit(2 * math.pi) * hours / 24
    means = timed.groupBy("entity", F.date_trunc(period, "observed_at").cast("date").alias("period_start")).agg(
        F.count("*").alias("events"), F.avg(F.sin(turn)).alias("_sin"), F.avg(F.cos(turn)).alias("_cos")
    )
    hour = F.atan2("_sin", "_cos") * 12 / math.pi
    # Directions without a resultant are noise of the last digits.
    steady = F.round(F.sqrt(F.col("_sin") * F.col("_sin") + F.col("_cos") * F.col("_cos")), 9)
    counted = means.select("entity", "period_start", "events", F.when(hour < 0, hour + 24).otherwise(hour).alias("mean_hour"), steady.alias("concentration"))
    counted = counted.filter((F.col("events") >= minimum_events) & (F.col("concentration") >= minimum_concentration) & (F.col("concentration") > 0))
    order = Window.partitionBy("entity").orderBy("period_start")
    names = ["period_start", "events", "mean_hour", "concentration"]
    paired = counted.withColumn("_before", F.lag(F.struct(*names)).over(order)).filter("_before IS NOT NULL")
    apart = F.col("mean_hour") - F.col("_before.mean_hour")
    shift = F.when(apart > 12, apart - 24).when(apart <= -12, apart + 24).otherwise(apart)
    return paired.filter(F.abs(shift) >= minimum_shift_hours).select(
        F.concat(F.lit("shift-"), F.col("entity").cast("string"), F.lit("-"), F.col("period_start").cast("string")).alias("candidate_id"),
        F.lit("activity-shift").alias("category"),
        F.lit("medium").alias("severity"),
        "entity",
        F.col("_before.period_start").alias("previous_period"),
        "period_start",
        F.col("_before.events").alias("previous_events"),
        "events",
        F.col("_before.mean_hour").alias("previous_hour"),
        "mean_hour",
        "concentration",
        shift.alias("shift_hours"),
    )


def great_circle_km(latitude: Column, longitude: Column, other_latitude: Column, other_longitude: Column) -> Column:
    """Distance of two points in degrees on a sphere (haversine)."""
    up = F.pow(F.sin(F.radians(other_latitude - latitude) / 2), F.lit(2.0))
    along = F.pow(F.sin(F.radians(other_longitude - longitude) / 2), F.lit(2.0))
    part = up + F.cos(F.radians(latitude)) * F.cos(F.radians(other_latitude)) * along
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(part, F.lit(1.0))))


def location_conflicts(
    first: DataFrame, second: DataFrame, *, maximum_speed_kmh: float = 900.0, minimum_distance_km: float = 50.0
) -> DataFrame:
    """Consecutive positions of an entity, over two tables together, that no journey connects.

    Both tables have entity, observed_at, latitude and longitude (degrees); rows that lack one
    or lie outside the degrees are left out. If any two positions of an entity are too far
    apart for the time between them, so are two consecutive ones on the way from one to the
    other, so every conflict shows up without pairing positions. Positions at one time are
    too far apart from ``minimum_distance_km`` on (speed NULL). Entities are ordered day by day.
    """
    checks.number("maximum_speed_kmh", maximum_speed_kmh, 1.0, 1_000_000.0)
    checks.number("minimum_distance_km", minimum_distance_km, 0.0, 20_100.0)
    names = ["entity", "observed_at", "latitude", "longitude"]
    both = first.select(*names, F.lit("first").alias("source")).unionByName(second.select(*names, F.lit("second").alias("source")))
    located = both.filter(
        "entity IS NOT NULL AND observed_at IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"
    ).distinct()
    order = [F.col(name) for name in ("observed_at", "latitude", "longitude", "source")]
    moved = with_previous_row(located, ["entity"], day_number(F.col("observed_at").cast("date")), order, [*names[1:], "source"])
    before = F.col("_previous")
    distance = great_circle_km(before["latitude"], before["longitude"], F.col("latitude"), F.col("longitude"))
    hours = (F.unix_micros(F.col("observed_at").cast("timestamp")) - F.unix_micros(before["observed_at"].cast("timestamp"))) / 3_600_000_000
    far = moved.filter("_previous IS NOT NULL").withColumn("distance_km", distance).withColumn("hours", hours)
    far = far.withColumn("speed_kmh", F.when(F.col("hours") > 0, F.col("distance_km") / F.col("hours")))
    return far.filter(
        (F.col("distance_km") >= minimum_distance_km) & F.coalesce(F.col("speed_kmh") > maximum_speed_kmh, F.lit(True))
    ).select(
        F.concat(F.lit("place-"), F.col("entity").cast("string"), F.lit("-"), F.unix_micros(F.col("observed_at").cast("timestamp")).cast("string")).alias("candidate_id"),
        F.lit("location-conflict").alias("category"),
        F.lit("medium").alias("severity"),
        "entity",
        before["observed_at"].alias("previous_at"),
        "observed_at",
        before["source"].alias("previous_source"),
        "source",
        "distance_km",
        "hours",
        "speed_kmh",
    )
