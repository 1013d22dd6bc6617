"""Ordered windows that do not gather a whole table or a hot key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.session import cut_lineage


def day_number(value: Column | str) -> Column:
    return F.datediff(value, F.lit("1970-01-01").cast("date"))


def with_preceding_rows(
    df: DataFrame,
    order: Sequence[str],
    rows: int,
    columns: dict[str, Column],
    *,
    partitions: int | None = None,
) -> DataFrame:
    """Window expressions over the ``rows`` rows before each row of one global order.

    ``columns`` maps a new name to an expression that is evaluated over
    ``Window.orderBy(order).rowsBetween(-rows, -1)`` without a PARTITION BY.
    One global window would run in one task. Here the rows are split into
    ranges of the order (``repartitionByRange`` samples the sort keys, so a hot
    timestamp is split by the later keys), the split is fixed by a checkpoint,
    and every range borrows the last rows of the ranges before it. The
    borrowed rows number at most ``rows`` per range.

    Rows equal in every order column stay together in one range, so pass enough
    columns to tell rows apart.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(count, *[F.col(name) for name in order]).withColumn("_part", F.spark_partition_id())
    )

    # Sizes of the ranges: one number per range, bounded by ``count``.
    sizes = dict(ranged.groupBy("_part").count().collect())
    lenders: list[tuple[int, int, int]] = []
    for part in sizes:
        needed = rows
        for earlier in range(part - 1, -1, -1):
            if needed <= 0:
                break
            available = min(needed, sizes.get(earlier, 0))
            if available:
                lenders.append((earlier, part, available))
                needed -= available

    own = ranged.withColumn("_borrowed", F.lit(False))
    if lenders:
        from_end = Window.partitionBy("_part").orderBy(*[F.col(name).desc() for name in order])
        tails = ranged.withColumn("_from_end", F.row_number().over(from_end)).filter(F.col("_from_end") <= rows)
        # Bounded by the number of ranges, so a broadcast is safe.
        plan = F.broadcast(spark.createDataFrame(lenders, "_part int, _to int, _take int"))
        borrowed = (
            tails.join(plan, "_part")
            .filter(F.col("_from_end") <= F.col("_take"))
            .select(*df.columns, F.col("_to").alias("_part"), F.lit(True).alias("_borrowed"))
        )
        own = own.unionByName(borrowed)

    window = Window.partitionBy("_part").orderBy(*[F.col(name) for name in order]).rowsBetween(-rows, -1)
    return (
        own.select("*", *[expression.over(window).alias(name) for name, expression in columns.items()])
        .filter(~F.col("_borrowed"))
        .drop("_part", "_borrowed")
    )


def with_highest_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    partitions: int | None = None,
) -> DataFrame:
    """``df`` with ``name``: the largest ``value`` among the rows of the key before each row (NULL for the first).

    A running maximum in three steps: rows are dealt into ranges of (keys, order),
    so a hot key covers many ranges; each range has one maximum per key; and
    where a key goes on from earlier ranges, their maxima are carried into it.
    A range goes on with at most one key, so no more rows are carried than there are
    ranges. Pass enough order columns to tell rows apart.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_value", value).repartitionByRange(count, *[F.col(n) for n in (*keys, *order)])
    ranged = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))
    highest = ranged.groupBy("_part", *keys).agg(F.max("_value").alias("_high"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = highest.withColumn("_carried", F.max("_high").over(earlier)).filter("_carried IS NOT NULL")
    carried = carried.select(F.col("_part").alias("_to"), "_carried", *[F.col(n).alias(f"_c_{n}") for n in keys])
    match = F.col("_part") == F.col("_to")
    for n in keys:
        match = match & F.col(n).eqNullSafe(F.col(f"_c_{n}"))
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(carried), match, "left")
        .withColumn(name, F.array_max(F.array(F.max("_value").over(within), F.col("_carried"))))
        .select(*df.columns, name)
    )


def with_row_number(df: DataFrame, order: Sequence[Column], name: str, *, partitions: int | None = None) -> DataFrame:
    """``df`` with ``name``: the number of each row in one global order, from 1.

    Rows are dealt into ranges of the order and numbered inside; a range starts
    after the sizes of the ranges before it, one number each. Rows that agree in every order
    column stay in one range.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(count, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Not more rows than ranges: one task adds them up, and a broadcast brings them back.
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + within).select(*df.columns, name)


def distinct_in_forward_window(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    member: str,
    window_days: int,
    *,
    anchors: DataFrame | None = None,
) -> DataFrame:
    """Per key and anchor day: how many distinct members occur in [day, day + window].

    A member seen on day d is counted by every anchor from d - window to d. Its
    days are turned into disjoint anchor spans, each span into a +1 and a -1,
    and the marks are summed per key and day. No self-join, and no set of
    members is held anywhere; after the sum a key holds at most one row per
    calendar day, whatever its size was. Returns every marked day with
    ``_members``; ``anchors`` (keys and day) adds days without any member.
    """
    days = df.select(*keys, member, day).distinct()
    per_member = Window.partitionBy(*keys, member).orderBy(day)
    spans = days.select(
        *keys,
        F.col(day).alias("_day"),
        F.when(
            F.col(member).isNotNull(),
            F.greatest(F.col(day) - window_days, F.lag(day).over(per_member) + 1),
        ).alias("_from"),
    )
    # The middle mark changes nothing; it makes every observed day an anchor.
    marks = spans.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("_from").alias("day"), F.lit(1).alias("change")),
                F.struct(F.col("_day").alias("day"), F.lit(0).alias("change")),
                F.struct(F.when(F.col("_from").isNotNull(), F.col("_day") + 1).alias("day"), F.lit(-1).alias("change")),
            )
        ).alias("_mark"),
    ).filter("_mark.day IS NOT NULL")
    marks = marks.select(*keys, F.col("_mark.day").alias(day), F.col("_mark.change").alias("_change"))
    if anchors is not None:
        marks = marks.unionByName(anchors.select(*keys, day, F.lit(0).alias("_change")))
    changes = marks.groupBy(*keys, day).agg(F.sum("_change").alias("_change"))
    running = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return changes.select(*keys, day, F.sum("_change").over(running).alias("_members"))


def nearest_days(df: DataFrame, anchors: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Per anchor (keys and day): the first day of ``df`` on or after it, and the last on or before it.

    An as-of join as two running aggregates over the union; a key holds at most
    two rows per calendar day.
    """
    both = (
        df.select(*keys, day, F.lit(True).alias("_seen"), F.lit(False).alias("_anchor"))
        .unionByName(anchors.select(*keys, day, F.lit(False).alias("_seen"), F.lit(True).alias("_anchor")))
        .groupBy(*keys, day)
        .agg(F.max("_seen").alias("_seen"), F.max("_anchor").alias("_anchor"))
    )
    seen_day = F.when(F.col("_seen"), F.col(day))
    whole = Window.partitionBy(*keys)
    ascending = whole.orderBy(F.col(day)).rowsBetween(Window.unboundedPreceding, 0)
    descending = whole.orderBy(F.col(day).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("_next", F.min(seen_day).over(descending))
        .withColumn("_previous", F.max(seen_day).over(ascending))
        .filter("_anchor")
        .select(*keys, day, "_next", "_previous")
    )


def with_previous_row(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """Columns of the row before each row of its key, as ``_previous`` (NULL for the first row).

    ``bucket`` is a coarse non-decreasing function of the order (a year, say). Rows
    are ordered per key and bucket, so a hot key is spread over its buckets; the
    first row of a bucket takes the last row of the key's bucket before, found
    among one row per key and bucket.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_row", F.struct(*columns))
    place = [*keys, "_bucket"]
    within = Window.partitionBy(*place).orderBy(*order)
    numbered = rows.withColumn("_nth", F.row_number().over(within)).withColumn("_before", F.lag("_row").over(within))
    backwards = Window.partitionBy(*place).orderBy(*[_reversed(column) for column in order])
    last_rows = rows.withColumn("_last", F.row_number().over(backwards)).filter("_last = 1")
    over_buckets = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last_rows.select(
        *[F.col(name).alias(f"_c_{name}") for name in place], F.lag("_row").over(over_buckets).alias("_carried")
    )
    match = F.lit(True)
    for name in place:
        match = match & F.col(name).eqNullSafe(F.col(f"_c_{name}"))
    return (
        numbered.join(carried, match, "left")
        .withColumn("_previous", F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_before")))
        .select(*df.columns, "_previous")
    )


def _reversed(column: Column) -> Column:
    """Descending order of a plain column, NULL last (the reverse of ascending, which has NULL first)."""
    return column.desc_nulls_last()
