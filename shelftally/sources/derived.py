"""A catalogue lake derived from the generic order tables, for tests and benchmarks."""

from collections.abc import Callable
from itertools import accumulate
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelftally.params import Params
from shelftally.sources.binding import bind
from shelftally.sources.lake import Lake, shared_folder

# One text for both engines: it runs unchanged in Spark SQL and in the SQL engine the
# results are checked against. An org is a nation, a record an order, a title a price
# bucket; hazards (noisy codes, bad dates, absent fields) follow from the order key.
TABLES = {
    "base": """\
SELECT lower(n_name) AS org, n_nationkey AS nk, o_orderkey AS k, o_orderdate AS od,
       concat(lower(n_name), ':', o_orderkey) AS record_id,
       CASE WHEN o_orderkey % 211 <> 0 THEN concat('t', CAST(floor(o_totalprice / 50) AS BIGINT)) END AS title_key
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "record_meta": """\
SELECT org, record_id, title_key FROM base""",
    "code_map": """\
SELECT lower(n_name) AS org, concat('N', n_nationkey) AS code, TRUE AS is_marc,
       concat(n_name, ' Library') AS registry_name, CAST(n_nationkey * 2 AS BIGINT) AS seq
FROM nation
UNION ALL
SELECT lower(n_name), concat('X', n_nationkey, '#'), FALSE,
       concat(n_name, ' Library'), CAST(n_nationkey * 2 + 1 AS BIGINT)
FROM nation
UNION ALL
SELECT lower(n_name), concat('N', n_nationkey, '-A'), TRUE, concat(n_name, ' Annex'), CAST(100 + n_nationkey AS BIGINT)
FROM nation WHERE n_nationkey % 3 = 0
UNION ALL
SELECT lower(n_name), concat('VEN', n_nationkey % 5), n_nationkey < 5, concat(n_name, ' Shared'), CAST(200 + n_nationkey AS BIGINT)
FROM nation WHERE n_nationkey < 10""",
    "records": """\
SELECT org, record_id, 'LDR' AS tag, 0 AS field_seq, CAST(NULL AS STRING) AS ind1,
       CAST(NULL AS STRING) AS ind2, CAST(NULL AS STRING) AS code,
       CAST(NULL AS INT) AS subfield_seq,
       concat('00000n',
         CASE k % 10 WHEN 0 THEN 't' WHEN 1 THEN 'p' WHEN 2 THEN 'e' WHEN 3 THEN 'j' ELSE 'a' END,
         CASE WHEN k % 7 = 0 THEN 's' WHEN k % 11 = 0 THEN 'c' ELSE 'm' END,
         ' a2200000 a 4500') AS value
FROM base
UNION ALL
SELECT org, record_id, '008', 1, NULL, NULL, NULL, NULL,
       concat(
         CASE WHEN k % 50 = 0 THEN '000000'
              WHEN k % 53 = 0 THEN 'xxxxxx'
              WHEN k % 4 = 0 THEN concat(CAST(66 + k % 33 AS STRING), '0101')
              ELSE concat(lpad(CAST(year(od) % 100 AS STRING), 2, '0'),
                          lpad(CAST(month(od) AS STRING), 2, '0'),
                          lpad(CAST(day(od) AS STRING), 2, '0')) END,
         CASE k % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'd' ELSE 'u' END,
         CASE WHEN k % 37 = 0 THEN '18uu' ELSE CAST(1850 + k % 170 AS STRING) END,
         CASE WHEN k % 5 = 0 THEN '9999' ELSE CAST(1850 + k % 170 + k % 40 AS STRING) END,
         CASE k % 6 WHEN 0 THEN 'cau' WHEN 1 THEN 'nyu' WHEN 2 THEN 'enk'
                    WHEN 3 THEN 'onc' WHEN 4 THEN 'fr ' ELSE 'uuu' END,
         '                 ',
         CASE WHEN k % 9 < 5 THEN 'eng' WHEN k % 9 < 7 THEN 'fre' ELSE 'ger' END, '  ')
FROM base WHERE k % 97 <> 0
UNION ALL
SELECT org, record_id, '020', 2, ' ', ' ', 'a', 0, CAST(k AS STRING) FROM base WHERE k % 2 = 0
UNION ALL
SELECT org, record_id, '035', 3, ' ', ' ', 'a', 0,
       CASE k % 8 WHEN 0 THEN concat('(OCoLC)', k) WHEN 1 THEN concat('(OCoLC-M)', k)
                  WHEN 2 THEN concat('(EXLCZ)', k) WHEN 3 THEN concat('(N', nk, ')', k)
                  WHEN 4 THEN concat('(N', (nk + 1) % 25, '-BR)', k) WHEN 5 THEN concat('(SIRSI)', k)
                  WHEN 6 THEN CAST(k AS STRING) ELSE concat('(CKB)', k) END
FROM base WHERE k % 17 <> 0
UNION ALL
SELECT org, record_id, '035', 4, ' ', ' ', 'a', 0, concat('(CStRLIN)', k) FROM base WHERE k % 6 = 0
UNION ALL
SELECT org, record_id, '040', 5, ' ', ' ', 'a', 0,
       CASE k % 6 WHEN 0 THEN 'DLC' WHEN 1 THEN ' *dlc-R*. ' WHEN 2 THEN concat('n', nk, '-br')
                  WHEN 3 THEN concat('X', k % 25, '#') WHEN 4 THEN concat('N', k % 25)
                  ELSE concat('VEN', k % 60) END
FROM base WHERE k % 13 <> 0
UNION ALL
SELECT org, record_id, '040', 5, ' ', ' ', 'a', 1, 'cDLC' FROM base WHERE k % 29 = 0 AND k % 13 <> 0
UNION ALL
SELECT org, record_id, 'LDR', 24, NULL, NULL, NULL, NULL, '00000npm a2200000 a 4500' FROM base WHERE k % 43 = 0
UNION ALL
SELECT org, record_id, '008', 20, NULL, NULL, NULL, NULL,
       concat('010203', 'd', CAST(1900 + k % 90 AS STRING), CAST(1910 + k % 90 AS STRING), 'stk',
              '                 ', 'spa', '  ')
FROM base WHERE k % 31 = 0
UNION ALL
SELECT org, record_id, '040', 21, ' ', ' ', 'a', 0, concat('N', nk, '-A-B') FROM base WHERE k % 13 = 0 AND k % 2 = 0
UNION ALL
SELECT org, record_id, '040', 22, ' ', ' ', 'a', 0, concat(chr(160), 'N', (nk + 1) % 25, chr(160)) FROM base WHERE k % 13 <> 5
UNION ALL
SELECT org, record_id, '856', 23, '4', '0', 'u', 0, concat('http://host', k % 9, '.example.org/', k) FROM base WHERE k % 10 = 3
UNION ALL
SELECT org, CAST(NULL AS STRING), '040', 5, ' ', ' ', 'a', 0, 'STRAY' FROM base WHERE k % 71 = 0
UNION ALL
SELECT org, CAST(NULL AS STRING), '650', 10, ' ', '0', 'a', 0, 'Stray' FROM base WHERE k % 73 = 0
UNION ALL
SELECT org, record_id, '040', 5, ' ', ' ', 'd', CAST(10 + l_linenumber AS INT),
       concat('M', CASE WHEN l_suppkey % 2 = 0 THEN 'od' ELSE 'OD' END, l_suppkey % 9)
FROM base JOIN lineitem ON l_orderkey = k WHERE k % 13 <> 0
UNION ALL
SELECT org, record_id, '050', 6, ' ', '0', 'a', 0,
       concat(CASE k % 5 WHEN 0 THEN 'QA' WHEN 1 THEN 'PN' WHEN 2 THEN 'QW ' WHEN 3 THEN '8' ELSE 'da' END, k % 999)
FROM base WHERE k % 4 <> 0
UNION ALL
SELECT org, record_id, CASE WHEN k % 3 = 0 THEN '100' ELSE '110' END, 7, '1', ' ', 'a', 0, concat('Name ', k % 500)
FROM base WHERE k % 4 <> 1
UNION ALL
SELECT org, record_id, '245', 8, '1', '0', 'a', 0, concat('Title ', coalesce(title_key, 'without a key')) FROM base
UNION ALL
SELECT org, record_id, '300', 9, ' ', ' ', 'a', 0, '1 v.' FROM base WHERE k % 20 <> 0
UNION ALL
SELECT org, record_id, '650', 10, ' ', '0', 'a', 0, concat('Topic ', k % 40) FROM base WHERE k % 3 <> 0
UNION ALL
SELECT org, record_id, '655', 11, ' ', '7', 'a', 0, concat(' Genre ', k % 15, CASE WHEN k % 2 = 0 THEN '. ' ELSE '' END)
FROM base WHERE k % 5 < 3
UNION ALL
SELECT org, record_id, '780', 12, '0', '0', 't', 0, 'Earlier' FROM base WHERE k % 4 = 2
UNION ALL
SELECT org, record_id, '785', 13, '0', CAST(k % 10 AS STRING), 't', 0, 'Later' FROM base WHERE k % 3 = 1
UNION ALL
SELECT org, record_id, '852', 14, CASE WHEN k % 2 = 0 THEN '0' ELSE '1' END, ' ', 'h', 0, concat('BX', k % 99)
FROM base WHERE k % 3 = 0
UNION ALL
SELECT org, record_id, '856', 15, '4', '0', 'u', 0,
       CASE WHEN k % 19 = 0 THEN concat('https://findingaids.', org, '.edu/', k)
            WHEN k % 23 = 0 THEN concat('https://hdl.', org, '.edu/', k)
            WHEN k % 31 = 0 THEN concat('HTTP://UPPER.example.org/', k) ELSE url END
FROM base JOIN pages ON page_id = k % 200""",
    "harvest_state": """\
SELECT concat('nation_', user_id % 25) AS org, max(ts) AS last_modified
FROM events GROUP BY user_id % 25""",
}


def with_clause() -> str:
    """The derived tables as one WITH clause, for engines that read them in one statement."""
    return "WITH " + ",\n".join(f"{name} AS (\n{body}\n)" for name, body in TABLES.items())


#: Records in one file of ``records``, which one task sorts and writes in memory.
FILE_RECORDS = 60_000
SOURCES = ("nation", "customer", "orders", "lineitem", "pages", "events")


def derived_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived tables over the Parquet tables in ``sf_dir``, still lazy."""
    known = _sources(spark, sf_dir)
    for name, body in TABLES.items():
        known[name] = bind(spark, body, **known)
    return {name: known[name] for name in TABLES if name != "base"}


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in SOURCES}


def _dealing(base: DataFrame) -> tuple[int, DataFrame]:
    """
    How many files hold all records, and for each org how many of them are its own and the
    number of the first: an org has as many files as its records fill, each filled by one task.
    """
    sizes = base.groupBy("org").count().orderBy("org").collect()
    files = [-(-r["count"] // FILE_RECORDS) for r in sizes]
    rows = [(r["org"], n, i) for r, n, i in zip(sizes, files, accumulate(files, initial=0), strict=False)]
    return max(1, sum(files)), base.sparkSession.createDataFrame(rows, "org string, _files int, _first int")


def _dealt(df: DataFrame, tasks: int, orgs: DataFrame, *order: str) -> DataFrame:
    """Rows in tasks by org and record, one file each, in order."""
    place = F.col("_first") + F.pmod(F.xxhash64("record_id"), F.col("_files"))
    placed = df.join(F.broadcast(orgs), "org", "left").repartitionById(tasks, place.cast("int"))
    return placed.drop("_files", "_first").sortWithinPartitions(*order)


def _write_base(spark: SparkSession, sources: dict[str, DataFrame], out: str) -> DataFrame:
    """
    The joins behind the tables as stored in a folder. They are done once, and their rows written
    by the tasks that joined them: no row moves again, and each file is in order by org, so that
    a filter on the org skips most of it.
    """
    base = bind(spark, TABLES["base"], **sources)
    base.sortWithinPartitions("org", "record_id").write.mode("overwrite").parquet(f"{out}/base")
    return spark.read.parquet(f"{out}/base")


def write_derived(spark: SparkSession, sf_dir: str, out: str) -> None:
    """The derived tables as a Parquet lake, in the layout of ``write_all_but_records``."""
    write_all_but_records(spark, sf_dir, out)()


def write_all_but_records(spark: SparkSession, sf_dir: str, out: str) -> Callable[[], None]:
    """
    Write the derived tables as a Parquet lake. ``records`` has a folder for each org, so
    that a filter on the org reads no other, and files sorted by tag, so that a filter on
    the tag skips row groups. An org's rows are dealt over several tasks by record. The joins
    behind the tables are done once, for ``base``, whose stored rows say how ``records`` are dealt.
    ``records`` is far the largest, and what is returned writes it.
    """
    known = _sources(spark, sf_dir)
    known["base"] = _write_base(spark, known, out)
    for name, body in TABLES.items():
        if name not in ("base", "records"):
            bind(spark, body, **known).write.mode("overwrite").parquet(f"{out}/{name}")

    def write_records() -> None:
        rows = _dealt(bind(spark, TABLES["records"], **known), *_dealing(known["base"]), "org", "tag", "record_id")
        rows.write.partitionBy("org").mode("overwrite").parquet(f"{out}/records")

    return write_records


def stored_lake(
    spark: SparkSession, out: str, params: Params | None = None, write_records: Callable[[], None] | None = None
) -> Lake:
    """The lake ``write_derived`` left in a folder, or one whose records are still to be written when first read."""
    return Lake.read(
        spark,
        f"{out}/records",
        f"{out}/record_meta",
        code_map=spark.read.parquet(f"{out}/code_map"),
        harvest_state_path=f"{out}/harvest_state",
        params=params,
        write_records=write_records,
    )


def derived_lake(spark: SparkSession, sf_dir: str, params: Params | None = None) -> Lake:
    """
    The derived lake. Where the cluster names a shared folder, the joins behind the tables are
    written there once. ``records`` stays lazy over them: a query makes the rows of the tags
    that it reads, which costs less than writing all rows for it, and moves no row.
    """
    tables = _sources(spark, sf_dir)
    folder = shared_folder(spark)
    if folder is not None:
        out = f"{folder}/derived-{uuid4().hex}"
        tables["base"] = _write_base(spark, tables, out)
    for name, body in TABLES.items():
        if name not in tables:
            tables[name] = bind(spark, body, **tables)
    lake = Lake(
        spark,
        tables["records"],
        tables["record_meta"],
        tables["code_map"],
        tables["harvest_state"],
        params,
    )
    if folder is not None:
        lake.own(out)
    return lake
