"""Hand-made contract rows."""

import datetime as dt

from leadspark.sources.contracts import contract_schema


def d(text):
    return dt.date.fromisoformat(text) if text else None


def table(spark, name, rows=()):
    """A contract table from dicts; columns left out are NULL."""
    schema = contract_schema(name)
    kinds = {field.name: field.dataType.typeName() for field in schema}
    for row in rows:
        assert set(row) <= set(kinds), set(row) - set(kinds)
    values = []
    for row in rows:
        values.append(
            tuple(
                d(row[name]) if kinds[name] == "date" and isinstance(row.get(name), str)
                else float(row[name]) if kinds[name] == "double" and row.get(name) is not None
                else row.get(name)
                for name in kinds
            )
        )
    return spark.createDataFrame(values, schema)


def rows(df, *columns):
    """Rows in the order of the result."""
    return [tuple(row[c] for c in columns) for row in df.collect()]
