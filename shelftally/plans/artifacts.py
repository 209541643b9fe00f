"""
The published artifacts: which tables each holds, the query text behind it, and writing.

An artifact is a folder with one table per section, every row stamped with the time of
the run; the manifest lists the artifacts with their description, the parameters of the run
and their SQL, which runs as it stands on the lake that was read. The tables are reports,
bounded by orgs and published axes, so each is written as one file in its reading order.
"""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelftally.functions import labels
from shelftally.operators import (
    archives,
    channels,
    comparison,
    coverage,
    fixed_fields,
    links,
    overlap,
    probe,
    provenance,
    serials,
)
from shelftally.plans import disclosure
from shelftally.sources.lake import ROSTER_SQL, Lake

Steps = list[tuple[str, str]]


@dataclass(frozen=True)
class Artifact:
    name: str
    description: str
    sections: dict[str, Callable[[Lake], DataFrame]]
    sql: Callable[[Lake], Steps]


def _patterns(lake: Lake) -> Steps:
    return [
        ("Orgs, numbered", f"CREATE OR REPLACE TEMP VIEW roster AS\n{ROSTER_SQL}"),
        (
            "Titles by holding pattern",
            f"CREATE OR REPLACE TEMP VIEW patterns AS\n{overlap.pattern_sql(lake.org_count)}",
        ),
    ]


def _overview_sql(lake: Lake) -> Steps:
    return [
        *_patterns(lake),
        ("Corpus totals", overlap.TOTALS_SQL),
        ("Records per org", overlap.ORG_RECORDS_SQL),
        ("Titles per org", overlap.org_titles_sql(lake.org_count)),
    ]


def _pairwise_sql(lake: Lake) -> Steps:
    return [
        *_patterns(lake),
        ("Titles per org", overlap.org_titles_sql(lake.org_count)),
        ("Shared titles of each pair", overlap.pairwise_sql(lake.org_count)),
    ]


def _provenance_sql(lake: Lake) -> Steps:
    return [
        *provenance.steps(lake.params),
        ("Kept, since what follows reads it more than once", "CACHE LAZY TABLE cataloging_source"),
        ("By year and origin, by agency and its owner, and by depth, in one pass", provenance.CELLS_SQL),
    ]


ARTIFACTS = (
    Artifact(
        "overview",
        "How large the lake is: records, distinct titles and orgs, then records, titles and last sync org by org.",
        {"totals": overlap.corpus_totals, "per_org": overlap.org_totals},
        _overview_sql,
    ),
    Artifact(
        "overlap_histogram",
        "One row for each possible number of holders, with the titles that have just that many.",
        {"held_by": overlap.overlap_histogram},
        lambda lake: [
            *_patterns(lake),
            ("Titles held by N orgs", overlap.histogram_sql(lake.org_count)),
        ],
    ),
    Artifact(
        "overlap_pairwise",
        "The titles of each org, and for two orgs at a time how many of them both own.",
        {"titles": overlap.org_titles, "pairs": overlap.overlap_pairwise},
        _pairwise_sql,
    ),
    Artifact(
        "uniqueness",
        "What would leave the consortium with an org: titles that no other one owns.",
        {"per_org": overlap.uniqueness},
        lambda lake: [
            *_patterns(lake),
            ("Titles held by one org", overlap.uniqueness_sql(lake.org_count)),
        ],
    ),
    Artifact(
        "publication_decade",
        "When the holdings were published: first dates of field 008 by decade, thin decades in one remainder.",
        {"per_org": comparison.publication_decade},
        lambda lake: [*fixed_fields.steps(), ("Records by decade", comparison.decade_sql(lake.params))],
    ),
    Artifact(
        "serials_timeline",
        "Serials over time: titles that were appearing in a year, and first years by decade.",
        {"active": serials.serials_active, "start_decade": serials.serials_start_decade},
        lambda lake: [
            *fixed_fields.steps(),
            ("Serials active per year", serials.active_sql(lake.params)),
            ("Serials by starting decade", serials.start_decade_sql(lake.params)),
        ],
    ),
    Artifact(
        "serials_succession",
        "What became of serials: those that name a predecessor or successor, and the relation named in 785.",
        {
            "succession_link": serials.succession_link,
            "succession_type": serials.succession_type,
        },
        lambda lake: [
            *serials.steps(),
            ("Serials per org", serials.TOTAL_SQL),
            ("Serials with an earlier or later title", serials.link_sql()),
            ("Serials by kind of later title", serials.type_sql()),
        ],
    ),
    Artifact(
        "archives",
        "Archival and manuscript records by kind, genre heading and first decade, and where their links lead.",
        {
            "material_type": archives.archive_type,
            "genre": archives.archive_genre,
            "start_decade": archives.archive_decade,
            "online_link": archives.archive_link,
            "link_destination": archives.archive_destination,
        },
        lambda lake: [
            *archives.steps(),
            *fixed_fields.steps(),
            ("Archival records per org", archives.TOTAL_SQL),
            ("Archival records by material", archives.TYPE_SQL),
            ("Archival records by genre term", archives.GENRE_SQL),
            ("Archival records by decade", archives.decade_sql(lake.params)),
            ("Archival records with an online link", archives.LINK_SQL),
            ("Link destinations by kind of host", archives.DESTINATION_SQL),
        ],
    ),
    Artifact(
        "electronic",
        "Which web hosts stand in the links of field 856, the most frequent of each org and the rest together.",
        {"hosts": links.link_hosts},
        lambda lake: [("Link hosts", links.HOST_SQL)],
    ),
    Artifact(
        "coverage",
        "Completeness: how many records have an identifier, subject, author, link, extent or call number.",
        {"per_org": coverage.coverage},
        lambda lake: [("Records carrying each field", coverage.coverage_sql())],
    ),
    Artifact(
        "cataloging_source",
        "Origin of descriptions in field 040: by kind of agency, by agency, between members, by later hands and by year of entry, with the code map behind it.",
        {
            "mix": provenance.cat_mix,
            "agency": provenance.cat_agency,
            "flow": provenance.cat_flow,
            "mod_depth": provenance.cat_mod_depth,
            "timeline": provenance.cat_timeline,
            "unplaced": provenance.cat_unplaced,
            "code_map_listed": provenance.code_map_listed,
            "code_map_via_family": provenance.code_map_via_family,
        },
        _provenance_sql,
    ),
    Artifact(
        "record_channels",
        "Ways that records came in, read off the namespaces of their control numbers, and those namespaces themselves.",
        {
            "coverage": channels.channel_coverage,
            "namespace": channels.channel_namespace,
        },
        lambda lake: [
            *channels.steps(),
            ("Records carrying each channel's number", channels.coverage_sql()),
            ("Namespaces: each org's own top ones, united", channels.namespace_sql(lake.params)),
            ("Namespace denominator: all records", channels.TOTAL_SQL),
        ],
    ),
    Artifact(
        "comparison",
        "Org beside org by coded values: languages, countries, types of record, classes of all records and of serials, serial status.",
        {
            "language": comparison.lang_matrix,
            "country": comparison.country_matrix,
            "record_type": comparison.record_type_matrix,
            "classification": comparison.lc_class,
            "serial_classification": comparison.lc_class_serial,
            "serial_status": serials.serial_status,
        },
        lambda lake: [
            *fixed_fields.steps(),
            ("Language", comparison.LANGUAGE_SQL),
            ("Place of publication", comparison.COUNTRY_SQL),
            ("Type of record", comparison.RECORD_TYPE_SQL),
            ("Subject class", comparison.lc_class_sql()),
            *serials.steps(),
            ("Subject class of serials", comparison.lc_class_sql(serials_only=True)),
            ("Status of serials", serials.status_sql()),
        ],
    ),
)

MANIFEST = T.StructType(
    [
        T.StructField("artifact", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("threshold", T.IntegerType()),
        T.StructField("params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("generated_at", T.StringType()),
        T.StructField("sections", T.ArrayType(T.StringType())),
        T.StructField(
            "sql",
            T.ArrayType(
                T.StructType(
                    [T.StructField("label", T.StringType()), T.StructField("sql", T.StringType())]
                )
            ),
        ),
    ]
)


def manifest(lake: Lake, generated_at: str, artifacts=ARTIFACTS) -> DataFrame:
    params = {name: str(value) for name, value in asdict(lake.params).items()}
    rows = [
        (
            a.name,
            a.description,
            lake.params.threshold,
            params,
            generated_at,
            list(a.sections),
            lake.steps(a.sql(lake)) + a.sql(lake),
        )
        for a in artifacts
    ]
    return lake.spark.createDataFrame(rows, MANIFEST)


# The column of a section that holds codes, and the names shown beside them.
NAMES = {
    "serials_succession/succession_link": ("category", labels.SUCCESSION_LINK),
    "serials_succession/succession_type": ("category", labels.SUCCESSION_TYPE),
    "archives/material_type": ("category", labels.RECORD_TYPE),
    "archives/link_destination": ("category", labels.DESTINATION),
    "coverage/per_org": ("field", labels.COVERAGE_FIELD),
    "cataloging_source/mix": ("bucket", labels.SOURCE_BUCKET),
    "cataloging_source/mod_depth": ("category", labels.MOD_DEPTH),
    "cataloging_source/timeline": ("bucket", labels.SOURCE_BUCKET),
    "record_channels/coverage": ("channel", labels.CHANNEL),
    "comparison/language": ("category", labels.LANGUAGE),
    "comparison/country": ("category", labels.PLACE),
    "comparison/record_type": ("category", labels.RECORD_TYPE),
    "comparison/classification": ("category", labels.LC_CLASS),
    "comparison/serial_classification": ("category", labels.LC_CLASS),
    "comparison/serial_status": ("category", labels.SERIAL_STATUS),
}
# Sections whose total is the sum of their categories, by the name under which they are audited.
SUMMED = {
    "comparison/language": "language",
    "comparison/country": "country",
    "comparison/record_type": "record_type",
    "comparison/classification": "lc_class",
    "comparison/serial_classification": "lc_class_serial",
    "comparison/serial_status": "serial_status",
    "cataloging_source/mod_depth": "mod_depth",
}
# Sections that are read largest first.
LARGEST_FIRST = {"overlap_pairwise/pairs": "shared", "uniqueness/per_org": "unique_titles"}


def reading_order(df: DataFrame, section: str = "") -> list:
    """By org, then by date, then in published order; what is left breaks ties."""
    simple = (T.ArrayType, T.StructType, T.MapType)
    names = [f.name for f in df.schema.fields if not isinstance(f.dataType, simple)]

    def place(name: str) -> tuple:
        date, rank = name in ("year", "decade"), name.endswith("_rank") or name == "place"
        return (name != "org", not date, not rank, name)

    order = [F.col(name) for name in sorted(names, key=place)]
    first = LARGEST_FIRST.get(section)
    return [F.desc(first), *order] if first else order


def _write(df: DataFrame, path: str, fmt: str, section: str = "") -> None:
    """One ordered file with its columns in name order; NULL stays visible as suppressed."""
    order = reading_order(df, section)
    out = df.select(*sorted(df.columns)).repartition(1).sortWithinPartitions(*order)
    writer = out.write.mode("overwrite")
    if fmt == "json":
        writer.option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown artifact format: {fmt}")


def write_artifacts(
    lake: Lake,
    out: str,
    *,
    fmt: str = "json",
    generated_at: str | None = None,
    artifacts=ARTIFACTS,
    at_once: int = 4,
    second_pass: bool = False,
) -> DataFrame:
    """
    Write every section of every artifact under ``out``, then the manifest; return it.
    A few artifacts are written at once: their last stages are too small to fill a cluster.
    With ``second_pass`` more is withheld where a total would give a small count away.
    """
    stamp = generated_at or datetime.now(UTC).isoformat()
    audited = disclosure.margins(lake)

    def write(artifact: Artifact) -> None:
        for section, build in artifact.sections.items():
            table = build(lake)
            summed = SUMMED.get(f"{artifact.name}/{section}")
            if second_pass and summed:
                table = disclosure.protected(table, lake.params.threshold, audited[summed].longest_axis)
            if f"{artifact.name}/{section}" in NAMES:
                table = labels.label(table, *NAMES[f"{artifact.name}/{section}"])
            table = table.withColumn("generated_at", F.lit(stamp))
            _write(table, f"{out}/{artifact.name}/{section}", fmt, f"{artifact.name}/{section}")

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(write, artifacts))
    listing = manifest(lake, stamp, artifacts)
    _write(listing, f"{out}/manifest", fmt)
    return listing


def write_probe(lake: Lake, path: str) -> None:
    """The code probe as one CSV with a header, largest codes of each org first."""
    (
        probe.code_probe(lake)
        .repartition(1)
        .sortWithinPartitions("org", F.desc("n"), "code")
        .write.mode("overwrite")
        .csv(path, header=True)
    )


def snapshot_diff(old: DataFrame, new: DataFrame, audit=("generated_at",)) -> DataFrame:
    """
    Rows that left (``-``) or came (``+``) between two versions of a table, the audit
    columns ignored. Repeated rows count as often as they occur. Empty means that
    nothing but the time of the run changed.
    """
    keys = [c for c in new.columns if c not in audit]
    signed = new.select(*keys, F.lit(1).alias("_n")).unionByName(
        old.select(*keys, F.lit(-1).alias("_n"))
    )
    moved = signed.groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    copies = F.expr("explode(sequence(1L, abs(_n)))")
    change = F.when(F.col("_n") > 0, F.lit("+")).otherwise(F.lit("-"))
    return moved.withColumn("_copy", copies).select(change.alias("change"), *keys)


# --- snapshots compared by digests ---------------------------------------------

#: Buckets that share one digest of the upper level.
FAN_OUT = 64


def write_snapshot(df: DataFrame, path: str, *, buckets: int = 256, audit=("generated_at",)) -> None:
    """
    Store a version of a table in folders by bucket of its rows' hash, beside a digest of each
    bucket: how many rows, and sums of two hashes of them, which do not depend on their order.
    """
    keys = sorted(c for c in df.columns if c not in audit)
    row = F.xxhash64(*(F.col(f"`{c}`") for c in keys)) if keys else F.lit(0).cast("long")
    dealt = df.withColumn("_bucket", F.pmod(row, F.lit(buckets)).cast("int"))
    dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
    # an empty version has no file that tells its columns
    df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.parquet(f"{path}/columns")
    stored = _stored_rows(df.sparkSession, path)
    hashes = [F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in keys)) for seed in (1, 2)]
    # halves of hashes are summed, since sums of whole ones overflow
    halves = [half for h in hashes for half in (F.pmod(h, F.lit(1 << 32)), F.shiftrightunsigned(h, 32))]
    sums = [F.sum(half).alias(f"sum_{i}") for i, half in enumerate(halves)]
    stored.groupBy("_bucket").agg(F.count("*").alias("rows"), *sums).coalesce(1).write.parquet(f"{path}/digests")


def _stored_rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(T.StructType([*columns.fields, T.StructField("_bucket", T.IntegerType())])).parquet(f"{path}/rows")


def _above(leaves: DataFrame) -> DataFrame:
    """The digests of groups of buckets."""
    together = F.xxhash64(F.array_sort(F.collect_list(F.struct(*sorted(leaves.columns)))).cast("string"))
    return leaves.groupBy(F.floor(F.col("_bucket") / FAN_OUT).alias("_bucket")).agg(together.alias("digest"))


def unequal_buckets(spark: SparkSession, old: str, new: str) -> list[int]:
    """Buckets whose rows differ between two snapshots, from their digests alone: groups first, then those below."""
    before, after = (spark.read.parquet(f"{path}/digests") for path in (old, new))

    def differing(left: DataFrame, right: DataFrame) -> list[int]:
        signed = left.unionAll(right)
        columns = signed.columns
        odd = signed.groupBy(*columns).count().where("count = 1").select("_bucket").distinct()
        return sorted(r["_bucket"] for r in odd.collect())

    groups = differing(_above(before), _above(after))
    if not groups:
        return []
    below = F.floor(F.col("_bucket") / FAN_OUT).isin(groups)
    return differing(before.where(below), after.where(below))


def diff_snapshots(spark: SparkSession, old: str, new: str, audit=("generated_at",)) -> DataFrame:
    """``snapshot_diff`` of two stored versions with the same number of buckets: only buckets that differ are read."""
    odd = unequal_buckets(spark, old, new)
    before, after = (_stored_rows(spark, path).where(F.col("_bucket").isin(odd)).drop("_bucket") for path in (old, new))
    return snapshot_diff(before, after, audit)


__all__ = [
    "ARTIFACTS",
    "Artifact",
    "manifest",
    "diff_snapshots",
    "snapshot_diff",
    "unequal_buckets",
    "write_artifacts",
    "write_probe",
    "write_snapshot",
]
