"""Where online links point."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelftally.functions import exprs as x
from shelftally.operators.heavy import top_values
from shelftally.sources.lake import Lake

HOST_SQL = f"""\
SELECT org, {x.link_host()} AS host, count(*) AS n
FROM records
WHERE tag = '856' AND code = 'u' AND {x.is_link()}
GROUP BY ALL"""


def host_counts(lake: Lake) -> DataFrame:
    """Links of each org per host, the whole tail."""
    return lake.counts("link_hosts", HOST_SQL)


def link_hosts(lake: Lake) -> DataFrame:
    """
    Each org's own most common link hosts. ``total`` counts all of its links, also those
    whose host is empty or too rare to list; an org with none listed keeps one row.
    """
    hosts = host_counts(lake)
    totals = hosts.groupBy("org").agg(F.sum("n").alias("total"))
    order = [F.desc("n"), F.asc("host")]
    top = (
        hosts.where((F.col("host") != "") & (F.col("n") >= lake.params.threshold))
        .withColumn("host_rank", F.row_number().over(Window.partitionBy("org").orderBy(*order)))
        .where(F.col("host_rank") <= lake.params.hosts_per_org)
    )
    return totals.join(top, "org", "left").select("org", "total", "host", "host_rank", "n")


def link_hosts_summarised(lake: Lake) -> DataFrame:
    """``link_hosts`` for lakes with many hosts: the tail of hosts is neither counted nor shuffled."""
    links = lake.sql(f"SELECT org, {x.link_host()} AS host FROM records WHERE tag = '856' AND code = 'u' AND {x.is_link()}")
    totals = links.groupBy("org").agg(F.count("*").alias("total"))
    p = lake.params
    top = top_values(links.where("host <> ''"), "org", "host", p.hosts_per_org, p.threshold)
    return totals.join(top, "org", "left").select("org", "total", "host", F.col("place").alias("host_rank"), "n")
