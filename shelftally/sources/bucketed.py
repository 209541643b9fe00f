"""
A lake laid out for work on records: folders by org, and buckets by record inside them.

All rows of a record lie in one bucket, so whatever groups or joins by record reads its
buckets side by side and shuffles nothing. An org has its own folders, so a filter on it, or
a refresh, touches no other. Files are sorted by tag, then by record: a filter on the tag
skips row groups, and a look-up of one record reads one bucket of one org, where the ranges
and Bloom filters of the row groups leave out the rest.
"""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelftally import schema
from shelftally.params import Params
from shelftally.sources.lake import Lake

KEY = "record_id"
TABLES = {"records": (schema.RECORDS, ["tag", KEY]), "record_meta": (schema.RECORD_META, [KEY])}
#: Tasks that write the rows without a record id, which would all fall into one bucket's task.
STRAY_TASKS = 8
#: Records of all orgs in one bucket, which one task sorts and groups in memory, and the least number of buckets.
BUCKET_RECORDS = 100_000
LEAST_BUCKETS = 8


def buckets_for(lake: Lake) -> int:
    """As many buckets as keep each of one size, however large the lake is."""
    return max(LEAST_BUCKETS, -(-lake.record_count // BUCKET_RECORDS))


def write_bucketed(lake: Lake, out: str, buckets: int | None = None, row_group_bytes: int = 64 << 20) -> None:
    """
    Write a lake's tables under ``out``, each org's records dealt over ``buckets``, by default
    as many as the lake's size asks for. A bucket is one task's work, and one file for each org.
    Rows without a record id share one bucket, in files of their own.
    """
    buckets = buckets or buckets_for(lake)
    # Bloom filters are sized for the records of a file; unsized, each takes a megabyte
    largest = lake.record_meta.groupBy("org").count().agg(F.max("count")).first()[0] or 1
    for name, (_, order) in TABLES.items():
        df = getattr(lake, name)
        known = df.where(f"{KEY} IS NOT NULL").repartition(buckets, KEY)
        stray = df.where(f"{KEY} IS NULL").repartition(STRAY_TASKS)
        table = f"written_{uuid4().hex}"
        (
            known.unionAll(stray)
            .write.format("parquet")
            .option("path", f"{out}/{name}")
            .option("parquet.block.size", row_group_bytes)
            .option(f"parquet.bloom.filter.enabled#{KEY}", True)
            .option(f"parquet.bloom.filter.expected.ndv#{KEY}", -(-largest // buckets))
            .partitionBy("org")
            .bucketBy(buckets, KEY)
            .sortBy(*order)
            .saveAsTable(table)
        )
        lake.spark.sql(f"DROP TABLE {table}")  # the name goes, the files stay
    for name in ("code_map", "harvest_state"):
        if getattr(lake, name) is not None:
            getattr(lake, name).write.parquet(f"{out}/{name}")
    layout = lake.spark.createDataFrame([(buckets, lake.code_map is not None, lake.harvest_state is not None)], "buckets int, code_map boolean, harvest_state boolean")
    layout.coalesce(1).write.parquet(f"{out}/layout")


def _declared(spark: SparkSession, name: str, path: str, buckets: int) -> tuple[str, DataFrame]:
    """The files as a table of a unique name whose buckets Spark knows."""
    declared, order = TABLES[name]
    table = f"bucketed_{uuid4().hex}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in declared.fields)
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (org)"
        f" CLUSTERED BY ({KEY}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.catalog.recoverPartitions(table)
    return table, spark.table(table)


def bucketed_lake(spark: SparkSession, out: str, params: Params | None = None) -> Lake:
    """The lake that ``write_bucketed`` left in a folder, with its layout; ``release`` forgets the names, not the files."""
    layout = spark.read.parquet(f"{out}/layout").first()
    tables = {name: _declared(spark, name, f"{out}/{name}", layout["buckets"]) for name in TABLES}
    lake = Lake(
        spark,
        tables["records"][1],
        tables["record_meta"][1],
        spark.read.parquet(f"{out}/code_map") if layout["code_map"] else None,
        spark.read.parquet(f"{out}/harvest_state") if layout["harvest_state"] else None,
        params,
        by_record=True,
    )
    lake.declared += [table for table, _ in tables.values()]
    return lake
