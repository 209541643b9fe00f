"""Whole records put back together from their subfield rows, and per-record lookups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelftally.sources.lake import DEAL, Lake

# One grouping by a hash of the record, which also leads the sort keys; a record's rows, once
# in order, are cut where the field changes, each row read once. A row without a subfield code
# is a leader or control field and carries the value.
NESTED_SQL = f"""\
SELECT org, record_id,
       transform(
         transform(starts, (s, i) -> slice(ordered, s, coalesce(get(starts, i + 1), size(ordered) + 1) - s)),
         g -> named_struct(
           'tag', g[0].tag, 'ind1', g[0].ind1, 'ind2', g[0].ind2,
           'value', array_max(transform(filter(g, r -> r.code IS NULL),
                      r -> named_struct('late', r.late, 'subfield_seq', r.subfield_seq, 'value', r.value))).value,
           'subfields', transform(
             sort_array(transform(filter(g, r -> r.code IS NOT NULL),
               r -> named_struct('late', r.late, 'subfield_seq', r.subfield_seq, 'code', r.code, 'value', r.value))),
             r -> named_struct('code', r.code, 'value', r.value)))
       ) AS fields
FROM (
  SELECT org, record_id, ordered,
         filter(sequence(1, size(ordered)),
                p -> p = 1 OR NOT (ordered[p - 1].field_seq <=> ordered[p - 2].field_seq)) AS starts
  FROM (
    SELECT org, record_id,
           sort_array(collect_list(named_struct(
             'field_seq', field_seq, 'late', subfield_seq IS NULL, 'subfield_seq', subfield_seq,
             'tag', tag, 'ind1', ind1, 'ind2', ind2, 'code', code, 'value', value))) AS ordered
    FROM (SELECT {DEAL}* FROM (SELECT xxhash64(org, record_id) AS h, * FROM records
                           WHERE org IS NOT NULL AND record_id IS NOT NULL))
    GROUP BY h, org, record_id
  )
)"""


def reconstitute(lake: Lake, org: str | None = None, record_id: str | None = None) -> DataFrame:
    """
    Records as ordered fields with ordered subfields, one row per record; an unknown id
    gives no row. Without arguments the whole lake is rebuilt, each record on its own.
    Rows without an org or an id belong to no record.
    """
    rows = lake.records
    if org is not None:
        rows = rows.where(F.col("org") == org)
    if record_id is not None:
        rows = rows.where(F.col("record_id") == record_id)
    return lake.sql(NESTED_SQL, records=rows)


TEXT = """\
array_join(transform(fields, f ->
  CASE WHEN size(f.subfields) = 0 THEN concat(f.tag, '      ', coalesce(f.value, ''))
       ELSE concat(f.tag, ' ', indicator(f.ind1), indicator(f.ind2), '  ',
                   array_join(transform(f.subfields, s -> concat('$', s.code, coalesce(s.value, 'None'))), ' '))
  END), '\\n')"""
TEXT = TEXT.replace("indicator(f.ind1)", "if(coalesce(f.ind1, '') = '', ' ', f.ind1)").replace(
    "indicator(f.ind2)", "if(coalesce(f.ind2, '') = '', ' ', f.ind2)"
)


def to_text(nested: DataFrame) -> DataFrame:
    """Render rebuilt records as readable text, one line per field."""
    return nested.select("org", "record_id", F.expr(TEXT).alias("text"))


def field_pivot(lake: Lake, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """
    Chosen fields as columns, one row per record that has any of them.
    ``fields`` maps a column name to a tag and a subfield code. String maxima are sorted,
    so rows are dealt and led by a hash of the record, as above: one exchange, one sort.
    """
    tags = sorted({tag for tag, _ in fields.values()})
    rows = lake.records.where(F.col("tag").isin(tags) & F.col("org").isNotNull() & F.col("record_id").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("org", "record_id"))
    return (
        (rows if lake.by_record else rows.repartition("h"))
        .groupBy("h", "org", "record_id")
        .agg(
            *[
                F.max(F.when((F.col("tag") == tag) & (F.col("code") == code), F.col("value"))).alias(name)
                for name, (tag, code) in fields.items()
            ]
        )
        .drop("h", "org")
    )


def org_field_count(lake: Lake, tag: str, code: str, org: str | None = None) -> DataFrame:
    """Subfield rows of one kind per org. An org filter prunes the lake's partitions."""
    rows = lake.records.where((F.col("tag") == tag) & (F.col("code") == code))
    if org is not None:
        rows = rows.where(F.col("org") == org)
    return rows.groupBy("org").agg(F.count("*").alias("n"))


def sample_values(lake: Lake, tag: str, code: str, n: int = 20) -> DataFrame:
    """The first ``n`` values of one subfield in record order."""
    return (
        lake.records.where((F.col("tag") == tag) & (F.col("code") == code))
        .orderBy("org", "record_id", "field_seq", "subfield_seq")
        .select("org", "record_id", "value")
        .limit(n)
    )
