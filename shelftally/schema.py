"""Declared schemas of the input tables and the check that a table fits one."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = T.StructType(
    [
        T.StructField("org", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("field_seq", T.IntegerType()),
        T.StructField("ind1", T.StringType()),
        T.StructField("ind2", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("subfield_seq", T.IntegerType()),
        T.StructField("value", T.StringType()),
    ]
)

RECORD_META = T.StructType(
    [
        T.StructField("org", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("title_key", T.StringType()),
    ]
)

HARVEST_STATE = T.StructType(
    [
        T.StructField("org", T.StringType()),
        T.StructField("last_modified", T.TimestampType()),
    ]
)

CODE_MAP = T.StructType(
    [
        T.StructField("org", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("is_marc", T.BooleanType()),
        T.StructField("registry_name", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)


# Types that may stand for one another within a column.
FAMILIES = (
    T.StringType,
    T.BooleanType,
    T.IntegralType,
    (T.TimestampType, T.TimestampNTZType),
)


class SchemaError(ValueError):
    """A table lacks a declared column or holds it with another type."""


def conform(df: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """Project ``df`` onto ``schema``; types may differ only within a family."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for field in schema.fields:
        got = have.get(field.name)
        if got is None:
            problems.append(f"{field.name} is missing")
        elif not any(
            isinstance(got, family) and isinstance(field.dataType, family) for family in FAMILIES
        ):
            problems.append(
                f"{field.name} is {got.simpleString()}, expected {field.dataType.simpleString()}"
            )
    if problems:
        raise SchemaError(f"{table}: " + "; ".join(problems))
    return df.select(
        *[
            F.col(f.name).cast(f.dataType).alias(f.name)
            if isinstance(f.dataType, T.IntegralType)
            else F.col(f.name)
            for f in schema.fields
        ]
    )
