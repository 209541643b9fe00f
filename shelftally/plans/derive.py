"""Measures derived from published counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelftally.operators import archives, serials
from shelftally.sources.lake import Lake


def share_of_org(counts: DataFrame, count: str) -> DataFrame:
    """Each row's share of its org's sum; an all-zero org has shares of 0."""
    whole = F.sum(count).over(Window.partitionBy("org"))
    share = F.expr(f"CASE WHEN _whole > 0 THEN {count} / CAST(_whole AS DOUBLE) ELSE 0D END")
    return counts.withColumn("_whole", whole).withColumn("share", share).drop("_whole")


def serial_vintage(lake: Lake) -> DataFrame:
    """Serials by starting decade, as shares of the org's dated serials."""
    return share_of_org(serials.serials_start_decade(lake), "records")


def archive_vintage(lake: Lake) -> DataFrame:
    """Archival records by starting decade, as shares of the org's dated ones."""
    return share_of_org(archives.archive_decade(lake), "n")


def vintage_share(lake: Lake) -> DataFrame:
    """Both vintages as one table."""
    serial = serial_vintage(lake).select(F.lit("serials").alias("subset"), "org", "decade", F.col("records").alias("n"), "share")
    archive = archive_vintage(lake).select(F.lit("archives").alias("subset"), "org", "decade", "n", "share")
    return serial.unionByName(archive)


def link_share(lake: Lake) -> DataFrame:
    """Share of archival records with an online link, best-linked org first."""
    rows = archives.archive_link(lake)
    share = F.expr("CASE WHEN total > 0 THEN n / CAST(total AS DOUBLE) ELSE 0D END")
    ranked = rows.withColumn("share", share)
    place = F.row_number().over(Window.orderBy(F.desc("share"), F.asc("org")))
    return ranked.withColumn("place", place)
