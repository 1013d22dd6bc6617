"""Small relational patterns shared by the detectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: up to so many keys are lent to every task.
_FEW_KEYS = 100_000


def top(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """The first ``limit`` rows in a total order (TakeOrderedAndProject); None keeps them all, in no order.

    Whoever stores, joins or groups a whole result would sort it in vain; call
    ``orderBy`` on it to look at it.
    """
    return df if limit is None else df.orderBy(*order).limit(limit)


def in_order(order: Sequence[Column], limit: int | None) -> Callable[[DataFrame], DataFrame]:
    """For ``transform``: sorts the rows that :func:`top` has cut (joins lose their order), leaves a whole result as it is."""
    return lambda df: df if limit is None else df.orderBy(*order)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key.

    Catalyst turns ``row_number() = 1`` into a group limit that runs before the
    shuffle, so each task sends at most one row per key however hot the key is.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).filter("_nth = 1").drop("_nth")


def one_row(df: DataFrame) -> Column:
    """A one-row DataFrame as a scalar subquery struct; read its fields with ``[name]``."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: str, pairs: DataFrame) -> DataFrame:
    """Inner join whose pairs are dealt out evenly over the tasks, however few keys most of them have.

    ``pairs``: at most one row per key, with the number of its pairs as a double
    in ``pairs``. A key with a sixteenth of a task's share or more gets a stretch
    of the tasks as long as its share: its left rows lie there by a hash of ``by``
    and its right rows, best the fewer, are repeated for each task of the stretch.
    Other keys lie in one task each, by their hash. Partitions are numbered, because
    adaptive execution would merge them by their size, which says nothing about the
    pairs. Rows whose key has no pairs leave before they are dealt, if there are few
    keys (counted first).
    """
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # At most 16 rows per task are left in these windows.
    total = F.broadcast(pairs.agg(F.sum("pairs").alias("_all")))
    heavy = pairs.join(total).filter(F.col("pairs") * (16 * tasks) >= F.col("_all"))
    ended = F.sum("pairs").over(Window.orderBy(*keys))
    scale = F.lit(float(tasks)) / F.sum("pairs").over(Window.partitionBy())
    stretches = heavy.select(*keys, ((ended - F.col("pairs")) * scale).alias("_from"), (F.col("pairs") * scale).alias("_long"))
    few = pairs.limit(_FEW_KEYS + 1).count() <= _FEW_KEYS
    stretches = F.broadcast(pairs.select(*keys).join(F.broadcast(stretches), list(keys), "left") if few else stretches)
    other = F.pmod(F.hash(*keys), F.lit(tasks))

    def task(at: Column) -> Column:
        return F.when(at.isNull(), other).otherwise(F.least(F.floor(at).cast("int"), F.lit(tasks - 1)))

    spread = F.pmod(F.xxhash64(by), F.lit(1 << 20)) / float(1 << 20)
    start, end = F.col("_from"), F.col("_from") + F.col("_long")
    placed, repeated = (side.join(stretches, list(keys), "inner" if few else "left") for side in (left, right))
    placed = placed.withColumn("_task", task(start + spread * F.col("_long")))
    repeated = repeated.withColumn("_task", F.explode(F.sequence(task(start), task(end))))
    placed, repeated = (side.drop("_from", "_long").repartitionById(tasks, F.col("_task")) for side in (placed, repeated))
    return placed.join(repeated, [*keys, "_task"]).drop("_task")


def with_joined_list(
    leads: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    value: str,
    alias: str,
    *,
    separator: str = " | ",
    first: int | None = None,
    distinct: bool = True,
    residual: str | None = None,
) -> DataFrame:
    """Add a sorted, joined text list per lead, NULL when it has no values.

    Every lead key occurs in ``source`` (leads are made from it), so an inner
    join keeps all leads. ``leads`` is already cut to the reported rows: lists are
    only built for those, and Catalyst broadcasts a limited ``leads``. Repeated
    values collapse before they are gathered; ``first`` keeps the first n values,
    again before gathering. ``residual`` is a further condition over lead columns
    and ``source`` columns.
    """
    lead_columns = leads.columns
    renamed = [F.col(key).alias(f"_k{i}") for i, key in enumerate(keys)]
    extra = [name for name in source.columns if residual and name not in lead_columns and name != value]
    match = F.lit(True)
    for i, key in enumerate(keys):
        match = match & F.col(f"_k{i}").eqNullSafe(leads[key])
    values = source.select(*renamed, F.col(value).alias("_v"), *extra).join(leads, match)
    if residual:
        values = values.filter(residual)
    values = values.select(*lead_columns, "_v")
    if distinct:
        values = values.distinct()
    if first is not None:
        window = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_last())
        values = values.withColumn("_nth", F.row_number().over(window)).filter(F.col("_nth") <= first)
    gathered = F.array_join(F.array_sort(F.collect_list("_v")), separator)
    return values.groupBy(*lead_columns).agg(F.when(F.count("_v") > 0, gathered).alias(alias))
