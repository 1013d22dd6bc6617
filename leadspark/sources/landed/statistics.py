"""JSON-stat cubes as observation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUBE = """
    class string, label string, updated string, id array<string>, size array<bigint>, value string, status string,
    dimension map<string,struct<category:struct<index:string,label:map<string,string>>>>,
    extension struct<status:struct<label:map<string,string>>>
"""


def _indexed(json: str, kind: str) -> Column:
    """(position, value) pairs of a JSON object keyed by position, or of a JSON array."""
    value = F.col(json)
    pairs = F.transform(
        F.map_entries(F.from_json(value, f"map<string,{kind}>")),
        lambda entry: F.struct(entry["key"].cast("bigint").alias("position"), entry["value"].alias("value")),
    )
    listed = F.transform(
        F.from_json(value, f"array<{kind}>"),
        lambda item, n: F.struct(n.cast("bigint").alias("position"), item.alias("value")),
    )
    every = F.when(F.ltrim(value).startswith("["), listed).otherwise(pairs)
    return F.filter(every, lambda pair: pair["value"].isNotNull())


def cube_observations(cubes: DataFrame, dataset: str = "dataset_code") -> DataFrame:
    """One row per cell with a value or a status, with codes and labels of every dimension.

    ``cubes`` has one cube per row and a ``dataset_code``. A flat position is a
    mixed radix number over the dimension sizes (the last one varies fastest):
    each dimension's coordinate is an integer division and a remainder. Only
    positions are exploded with the small size list; codes and labels meet the
    cells by an equality on (dataset, dimension, coordinate).
    """
    cubes = cubes.filter("class = 'dataset'")
    values = cubes.select(dataset, F.explode(_indexed("value", "double")).alias("p")).select(dataset, "p.*")
    statuses = cubes.select(dataset, F.explode(_indexed("status", "string")).alias("p")).select(
        dataset, "p.position", F.col("p.value").alias("status")
    )
    cells = values.join(statuses, [dataset, "position"], "full_outer")

    dimensions = cubes.select(
        dataset,
        "dimension",
        F.posexplode("id").alias("place", "name"),
        F.col("size"),
    ).select(
        dataset,
        "name",
        "place",
        F.get("size", F.col("place")).alias("length"),
        F.aggregate(
            F.slice("size", F.col("place") + 2, F.size("size")), F.lit(1).cast("bigint"), lambda product, n: product * n
        ).alias("stride"),
        F.try_element_at("dimension", F.col("name"))["category"].alias("category"),
    )
    index = F.col("category.index")
    codes = F.when(
        F.ltrim(index).startswith("["),
        F.transform(
            F.from_json(index, "array<string>"),
            lambda code, n: F.struct(code.alias("code"), n.cast("bigint").alias("coordinate")),
        ),
    ).otherwise(
        F.transform(
            F.map_entries(F.from_json(index, "map<string,bigint>")),
            lambda entry: F.struct(entry["key"].alias("code"), entry["value"].alias("coordinate")),
        )
    )
    categories = dimensions.select(
        dataset, "name", "place", F.explode(codes).alias("c"), F.col("category.label").alias("labels")
    ).select(
        dataset,
        "name",
        "place",
        F.col("c.coordinate").alias("coordinate"),
        F.col("c.code").alias("code"),
        F.coalesce(F.try_element_at("labels", F.col("c.code")), F.col("c.code")).alias("label"),
    )
    radix = dimensions.groupBy(dataset).agg(
        F.array_sort(F.collect_list(F.struct("place", "length", "stride"))).alias("radix")
    )
    coordinates = (
        cells.join(radix, dataset)
        .select(dataset, "position", F.explode("radix").alias("r"))
        .select(
            dataset,
            "position",
            F.col("r.place").alias("place"),
            F.expr("(position div r.stride) % r.length").alias("coordinate"),
        )
    )
    # A cell has as many rows here as the cube has dimensions.
    described = (
        coordinates.join(categories, [dataset, "place", "coordinate"])
        .groupBy(dataset, "position")
        .agg(F.array_sort(F.collect_list(F.struct("place", "name", "code", "label"))).alias("d"))
    )

    def by_name(field: str) -> Column:
        return F.map_from_entries(F.transform("d", lambda item: F.struct(item["name"], item[field])))

    def first_code(*names: str) -> Column:
        return F.get(F.filter("d", lambda item: F.lower(item["name"]).isin(*names)), 0)["code"]

    heads = cubes.select(
        dataset, F.col("label").alias("dataset_label"), "updated", F.col("extension.status.label").alias("status_labels")
    )
    return (
        cells.join(described, [dataset, "position"])
        .join(heads, dataset)
        .select(
            dataset,
            "dataset_label",
            "updated",
            "position",
            first_code("time", "time_period").alias("time_period"),
            "value",
            first_code("unit").alias("unit"),
            "status",
            F.try_element_at("status_labels", F.col("status")).alias("status_label"),
            by_name("code").alias("dimensions"),
            by_name("label").alias("dimension_labels"),
        )
    )
