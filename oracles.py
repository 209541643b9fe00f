"""
The expected result of every registered query, as DuckDB SQL over the driver tables.

Each text states its measure directly over the derived catalogue tables and shares no
code with the operators; only the tables' own derivation is common to both engines.
"""

from shelftally.sources.derived import with_clause

THRESHOLD = 10
NOW = 2026

SERIAL = "(SELECT DISTINCT org, record_id FROM records WHERE tag = 'LDR' AND value[8] = 's')"
ARCHIVE = """(
  SELECT org, record_id, value[7] AS kind FROM records
  WHERE tag = 'LDR' AND length(value) >= 8 AND (value[7] IN ('t','d','f','p') OR value[8] IN ('c','d')))"""
HELD = "(SELECT org, count(*) AS total FROM record_meta GROUP BY org)"
AGENCY = r"upper(trim(value, ' *.,;:' || chr(9) || chr(10) || chr(13) || chr(160)))"
PREFIX = r"upper(trim(regexp_extract(value, '^\s*\(([^)]{1,24})\)', 1)))"


def q(body: str, *ctes: str) -> str:
    """A query over the derived tables, with any further named steps in front of it."""
    return ",\n".join([with_clause(), *ctes]) + "\n" + body


def year(text: str) -> str:
    return f"CASE WHEN regexp_full_match({text}, '[0-9]{{4}}') THEN TRY_CAST({text} AS INT) END"


DATE1 = "substr(value, 8, 4)"
DATE2 = "substr(value, 12, 4)"


def shown(n: str = "n") -> str:
    return f"CASE WHEN {n} > 0 AND {n} < {THRESHOLD} THEN NULL ELSE {n} END"


def ratio(n: str, whole: str) -> str:
    return f"({n})::DOUBLE / nullif({whole}, 0)"


def values(items) -> str:
    rows = ", ".join(f"('{c}', {i})" for i, c in enumerate(items, 1))
    return f"(SELECT * FROM (VALUES {rows}) v(category, cat_rank))"


def grid(counts: str, *, axis=None, top=None, totals: str | None = None, last: str | None = None) -> str:
    """The comparison matrix over ``counts(org, category, n)``."""
    if axis is None:
        axis = (
            "(SELECT category, row_number() OVER (ORDER BY sum(n) DESC, category) AS cat_rank"
            " FROM counts GROUP BY category"
            + (f" QUALIFY cat_rank <= {top}" if top else "")
            + ")"
        )
    elif not isinstance(axis, str):
        axis = values(axis)
    totals = totals or "(SELECT org, sum(n) AS total FROM counts GROUP BY org)"
    columns = last or f", t.total::BIGINT AS total, {ratio(shown('coalesce(c.n, 0)'), 't.total')} AS share"
    body = f"""\
SELECT t.org, a.category, a.cat_rank::INT AS cat_rank, ({shown('coalesce(c.n, 0)')})::BIGINT AS n{columns}
FROM {totals} t CROSS JOIN {axis} a
LEFT JOIN counts c ON c.org = t.org AND c.category = a.category"""
    return q(body, f"counts AS (\n{counts}\n)")


# --- overlap -----------------------------------------------------------------

HOLDINGS = "holdings AS (SELECT DISTINCT org, title_key FROM record_meta)"
SIZES = "sizes AS (SELECT org, count(title_key) AS titles FROM holdings GROUP BY org)"
SHARED = """\
shared AS (
  SELECT x.org AS a, y.org AS b, count(*) AS shared
  FROM holdings x JOIN holdings y ON x.title_key = y.title_key AND x.org < y.org
  GROUP BY x.org, y.org)"""
PAIRS = """\
pairs AS (
  SELECT x.org AS a, y.org AS b, x.titles AS ta, y.titles AS tb, coalesce(s.shared, 0) AS shared
  FROM sizes x JOIN sizes y ON x.org < y.org LEFT JOIN shared s ON s.a = x.org AND s.b = y.org)"""
WIDTH = "width AS (SELECT title_key, count(*) AS k, string_agg(org, ',' ORDER BY org) AS holders, min(org) AS one FROM holdings GROUP BY title_key)"
JACCARD = ratio("shared", "ta + tb - shared")
ORDERED = """(
  SELECT a, b, shared, ta AS own FROM pairs UNION ALL SELECT b, a, shared, tb FROM pairs)"""
GROUP = "('nation_1', 'nation_2', 'nation_3')"
IN_GROUP = f"chosen AS (SELECT title_key, count(*) AS k, min(org) AS one FROM holdings WHERE org IN {GROUP} AND title_key IS NOT NULL GROUP BY title_key)"

# --- provenance --------------------------------------------------------------

OWNERS = """\
claims AS (
  SELECT m.code, m.is_marc, m.org, min(m.seq) OVER (PARTITION BY m.org) AS org_seq FROM code_map m)"""


def owned(codes: str, name: str = "owned") -> str:
    """First-listed org whose claim matches a code exactly or as a MARC family."""
    return f"""\
{name} AS (
  SELECT u.code, arg_min(c.org, c.org_seq) AS owner
  FROM ({codes}) u JOIN claims c
    ON u.code = c.code OR (c.is_marc AND starts_with(u.code, c.code || '-'))
  GROUP BY u.code)"""


PER_RECORD = f"""\
agencies AS (
  SELECT org, record_id, code AS sub, field_seq, subfield_seq, {AGENCY} AS agency
  FROM records WHERE tag = '040'),
per_record AS (
  SELECT m.org, m.record_id, o.agency AS source_code, coalesce(d.k, 0) AS k, f.record_id IS NOT NULL AS has_040,
         CASE WHEN regexp_full_match(e.stamp, '[0-9]{{6}}') AND e.stamp <> '000000'
              THEN stamp[1:2]::INT + CASE WHEN stamp[1:2]::INT <= {NOW % 100} THEN 2000 ELSE 1900 END END AS entered
  FROM record_meta m
  LEFT JOIN (SELECT DISTINCT org, record_id FROM agencies) f USING (org, record_id)
  LEFT JOIN (SELECT org, record_id, arg_min(agency, field_seq * 1000000 + subfield_seq) AS agency
             FROM agencies WHERE sub = 'a' AND agency <> '' GROUP BY ALL) o USING (org, record_id)
  LEFT JOIN (SELECT org, record_id, count(DISTINCT agency) AS k
             FROM agencies WHERE sub = 'd' AND agency <> '' GROUP BY ALL) d USING (org, record_id)
  LEFT JOIN (SELECT org, record_id, arg_min(substr(value, 1, 6), field_seq) AS stamp
             FROM records WHERE tag = '008' GROUP BY ALL) e USING (org, record_id))"""
SOURCED = ",\n".join(
    [
        PER_RECORD,
        OWNERS,
        owned("SELECT DISTINCT source_code AS code FROM per_record WHERE source_code IS NOT NULL"),
        """\
sourced AS (
  SELECT p.*, w.owner,
         CASE WHEN source_code IS NULL THEN 'none'
              WHEN source_code = 'DLC' OR source_code LIKE 'DLC-%' THEN 'lc'
              WHEN w.owner = p.org THEN 'self' WHEN w.owner IS NOT NULL THEN 'pod' ELSE 'other' END AS bucket,
         CASE WHEN NOT has_040 THEN 'no_040' WHEN k >= 10 THEN '10+' WHEN k >= 5 THEN '5-9'
              WHEN k >= 3 THEN '3-4' ELSE k::VARCHAR END AS depth
  FROM per_record p LEFT JOIN owned w ON w.code = p.source_code)""",
    ]
)
BUCKETS = ("lc", "self", "pod", "other", "none")
PLACED = f"""\
years AS (
  SELECT org, entered, count(*) AS total FROM sourced
  WHERE entered BETWEEN 1966 AND {NOW} GROUP BY org, entered HAVING count(*) >= {THRESHOLD}),
cells AS (
  SELECT y.org, y.entered AS year, y.total, s.bucket, count(*) AS n
  FROM years y JOIN sourced s ON s.org = y.org AND s.entered = y.entered GROUP BY ALL),
timeline AS (
  SELECT y.org, y.entered AS year, v.category AS bucket, v.cat_rank::INT AS bucket_rank, y.total,
         coalesce(sum(c.n), 0)::BIGINT AS n
  FROM years y CROSS JOIN {values(BUCKETS)} v
  LEFT JOIN cells c ON c.org = y.org AND c.year = y.entered
    AND v.category = CASE WHEN c.n < {THRESHOLD} THEN 'other' ELSE c.bucket END
  GROUP BY ALL),
unplaced AS (
  SELECT s.org, count(*) FILTER (WHERE y.org IS NULL) AS unplaced
  FROM sourced s LEFT JOIN years y ON y.org = s.org AND y.entered = s.entered GROUP BY s.org)"""
AGENCY_COUNTS = """\
SELECT org, source_code AS category, count(*) AS n FROM sourced WHERE source_code IS NOT NULL GROUP BY ALL"""
OWN_CODES = "own AS (SELECT org, source_code AS code, count(*) AS n FROM sourced WHERE owner = org GROUP BY ALL)"


def sourced_grid(counts: str, **options) -> str:
    text = grid(counts, **options)
    return text.replace("counts AS (", f"{SOURCED},\ncounts AS (", 1)


# --- channels ----------------------------------------------------------------

NUMBERS = f"numbers AS (SELECT org, record_id, {PREFIX} AS prefix FROM records WHERE tag = '035' AND code = 'a')"
CHANNELS = {
    "oclc": "prefix LIKE 'OCOLC%'",
    "rlin": "prefix = 'CSTRLIN'",
    "alma_cz": "prefix IN ('EXLCZ', 'CKB')",
    "local_system": "owner = n.org OR prefix IN ('SIRSI', 'PUVOYAGERBIBID')",
    "pod_system": "owner <> n.org",
    "any_system": "prefix <> ''",
}
CARRIED = ",\n".join(
    [
        NUMBERS,
        OWNERS,
        owned("SELECT DISTINCT prefix AS code FROM numbers"),
        "carried AS (SELECT n.org, n.record_id, prefix, owner FROM numbers n LEFT JOIN owned w ON w.code = n.prefix)",
    ]
)
CHANNEL_ROWS = " UNION ALL ".join(
    f"SELECT h.org, '{c}' AS channel, {i}::INT AS channel_rank, h.total,"
    f" (SELECT count(DISTINCT record_id) FROM carried n WHERE n.org = h.org AND ({test})) AS n FROM {HELD} h"
    for i, (c, test) in enumerate(CHANNELS.items(), 1)
)

# --- call numbers ------------------------------------------------------------

LOCATED = """\
located AS (
  SELECT org, record_id, upper(trim(value)[1]) AS category,
         row_number() OVER (PARTITION BY org, record_id ORDER BY
           list_position(['050a','090a','852h','950a','900f','099a','949a'], tag || code), field_seq, subfield_seq) AS place
  FROM records
  WHERE list_contains(['050a','090a','852h','950a','900f','099a','949a'], tag || code)
    AND (tag <> '852' OR ind1 = '0')
    AND regexp_matches(upper(trim(value)), '^[A-HJ-NP-VZ]') AND NOT regexp_matches(upper(trim(value)), '^Q[S-Z]'))"""


def lc(where: str = "true") -> str:
    text = grid(f"SELECT org, category, count(*) AS n FROM located WHERE place = 1 AND {where} GROUP BY ALL")
    return text.replace("counts AS (", f"{LOCATED},\ncounts AS (", 1)


FIELD_TESTS = {
    "isbn": "tag = '020'",
    "subjects": "tag LIKE '6%'",
    "author": "tag IN ('100','110','111')",
    "online": "tag = '856'",
    "phys_desc": "tag = '300'",
}
FIELD_ROWS = " UNION ALL ".join(
    [
        f"SELECT org, '{f}' AS field, count(DISTINCT record_id) AS n FROM records WHERE {t} GROUP BY org"
        for f, t in FIELD_TESTS.items()
    ]
    + ["SELECT org, 'lc_classification', count(DISTINCT record_id) FROM located GROUP BY org"]
)
FIELDS = f"""\
{LOCATED},
fields AS (
  SELECT h.org, f.field, coalesce(r.n, 0) AS n, h.total AS records,
         round(coalesce(r.n, 0)::DOUBLE / h.total, 4) AS share
  FROM {HELD} h
  CROSS JOIN (SELECT unnest(['isbn','subjects','author','online','phys_desc','lc_classification']) AS field) f
  LEFT JOIN ({FIELD_ROWS}) r ON r.org = h.org AND r.field = f.field)"""

# --- serials, archives, links ------------------------------------------------

SERIAL_008 = f"(SELECT r.org, r.record_id, r.value FROM records r JOIN {SERIAL} s USING (org, record_id) WHERE r.tag = '008')"
SERIAL_TOTAL = f"(SELECT org, count(*) AS total FROM {SERIAL} GROUP BY org)"
STATUS = f"SELECT org, value[7] AS category, count(*) AS n FROM {SERIAL_008} WHERE value[7] IN ('c','d','u') GROUP BY ALL"
START = f"""\
SELECT org, (y // 10) * 10 AS decade, count(*) AS records
FROM (SELECT org, {year(DATE1)} AS y FROM {SERIAL_008} WHERE length(value) >= 11)
WHERE y BETWEEN 1700 AND 2025 GROUP BY ALL"""
# The same serials before the first years of French ones were corrected from 18.. to 19..
EARLIER = f"""\
SELECT org, (y // 10) * 10 AS decade, count(*) AS records
FROM (SELECT org, {year(DATE1)} - CASE WHEN substr(value, 36, 3) = 'fre' AND substr(value, 8, 2) = '19' THEN 100 ELSE 0 END AS y
      FROM {SERIAL_008} WHERE length(value) >= 11)
WHERE y BETWEEN 1700 AND 2025 GROUP BY ALL"""
ARCHIVE_TOTAL = f"(SELECT org, count(*) AS total FROM {ARCHIVE} GROUP BY org)"
ARCHIVE_START = f"""\
SELECT org, (y // 10) * 10 AS decade, count(*) AS n
FROM (SELECT r.org, {year('substr(r.value, 8, 4)')} AS y
      FROM records r JOIN {ARCHIVE} a USING (org, record_id) WHERE r.tag = '008' AND length(r.value) >= 11)
WHERE y BETWEEN 100 AND 2025 GROUP BY ALL"""
HOSTS = """\
hosts AS (
  SELECT org, regexp_extract(lower(value), 'https?://([^/]+)', 1) AS host, count(*) AS n
  FROM records WHERE tag = '856' AND code = 'u' AND value LIKE 'http%' GROUP BY ALL)"""
DESTINATION = r"""
CASE WHEN host SIMILAR TO '.*(findingaid|archives).*' THEN 'finding_aid'
     WHEN host IN ('oac.cdlib.org', 'www.oac.cdlib.org') OR host SIMILAR TO '.*(archivegrid|snaccooperative).*' THEN 'aggregator'
     WHEN split_part(host, '.', 1) IN ('nrs','arks','purl','hdl','handle') AND contains(host, '.') OR host LIKE '%doi.org' THEN 'resolver'
     WHEN host SIMILAR TO '.*(proquest|amdigital|gale|jstor|e-enlightenment).*' THEN 'vendor'
     WHEN host SIMILAR TO '.*(colenda|digital|repository|dspace|fedora|idn\.duke).*' THEN 'repository'
     ELSE 'other' END"""
DESTINATIONS = f"""\
SELECT org, category, count(DISTINCT record_id) AS n
FROM (SELECT org, record_id, {DESTINATION} AS category
      FROM (SELECT r.org, r.record_id, regexp_extract(lower(r.value), 'https?://([^/]+)', 1) AS host
            FROM records r JOIN {ARCHIVE} a USING (org, record_id)
            WHERE r.tag = '856' AND r.code = 'u' AND r.value LIKE 'http%'))
GROUP BY ALL"""
LINKED = f"""(
  SELECT t.org, coalesce(r.n, 0) AS n, t.total FROM {ARCHIVE_TOTAL} t
  LEFT JOIN (SELECT org, count(*) AS n FROM {ARCHIVE}
             WHERE (org, record_id) IN (SELECT (org, record_id) FROM records WHERE tag = '856' AND code = 'u')
             GROUP BY org) r USING (org))"""

# --- comparison --------------------------------------------------------------

LANGUAGE = """\
SELECT org, upper(trim(substr(value, 36, 3))) AS category, count(*) AS n
FROM records WHERE tag = '008' AND length(value) >= 38 AND trim(substr(value, 36, 3)) <> '' GROUP BY ALL"""
US = (
    "XXU ALU AKU AZU ARU CAU COU CTU DCU DEU FLU GAU HIU IDU ILU INU IAU KSU KYU LAU MEU MDU MAU "
    "MIU MNU MSU MOU MTU NBU NVU NHU NJU NMU NYU NCU NDU OHU OKU ORU PAU RIU SCU SDU TNU TXU UTU "
    "VTU VAU WAU WVU WIU WYU"
)
COUNTRY = f"""\
SELECT org, CASE WHEN list_contains(string_split('{US}', ' '), p) THEN 'XXU'
                 WHEN list_contains(string_split('XXC ABC BCC MBC NKC NFC NSC NTC NUC ONC PIC QUC SNC YKC', ' '), p) THEN 'XXC'
                 WHEN list_contains(string_split('XXK ENK STK WLK NIK UIK', ' '), p) THEN 'XXK'
                 WHEN p = 'UUU' THEN 'XX' ELSE p END AS category, count(*) AS n
FROM (SELECT org, upper(trim(substr(value, 16, 3))) AS p FROM records WHERE tag = '008' AND length(value) >= 18)
WHERE p <> '' GROUP BY ALL"""
RECORD_TYPE = """\
SELECT org, value[7] AS category, count(*) AS n
FROM records WHERE tag = 'LDR' AND length(value) >= 7 AND trim(value[7]) <> '' GROUP BY ALL"""
DECADES = f"""\
decades AS (
  SELECT org, (y // 10) * 10 AS decade, count(*) AS n
  FROM (SELECT org, {year(DATE1)} AS y FROM records WHERE tag = '008')
  WHERE y BETWEEN 1450 AND 2030 GROUP BY ALL),
folded AS (
  SELECT org, CASE WHEN n >= {THRESHOLD} THEN decade::INT END AS decade, n < {THRESHOLD} AS is_other,
         sum(n)::BIGINT AS records
  FROM decades GROUP BY ALL)"""


def named(counts: str, column: str, names: dict, with_code: bool) -> str:
    arms = " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in names.items())
    name = f"CASE lower(category) {arms} END"
    shown_name = f"{name} || ' (' || category || ')'" if with_code else name
    return f"SELECT DISTINCT category, coalesce({shown_name}, category) AS label FROM ({counts})"


NAMESPACE_COUNTS = f"""\
SELECT u.org, u.prefix AS category, u.n
FROM used u WHERE u.prefix IN (
  SELECT prefix FROM (
    SELECT u.prefix, row_number() OVER (PARTITION BY u.org ORDER BY u.n DESC, u.prefix) AS place
    FROM used u JOIN {HELD} h USING (org) WHERE u.n >= h.total * 0.001)
  WHERE place <= 12)"""
USED = f"{NUMBERS},\nused AS (SELECT org, prefix, count(DISTINCT record_id) AS n FROM numbers WHERE prefix <> '' GROUP BY ALL)"


# Names as a reader expects them, written out here so that a wrong one can be found:
# labelled query -> (the report, its column, names by code).
LABELLED = {
    "labelled_record_type": ("record_type_matrix", "category", {
        "a": "Language material", "c": "Notated music", "d": "Manuscript music", "e": "Cartographic",
        "f": "Manuscript cartographic", "g": "Projected medium", "i": "Nonmusical sound", "j": "Musical sound",
        "k": "Two-dimensional image", "m": "Computer file", "o": "Kit", "p": "Mixed material",
        "r": "Three-dimensional object", "t": "Manuscript language material",
    }),
    "labelled_lc_class": ("lc_class", "category", {
        "b": "Philosophy & Religion", "d": "World History", "p": "Language & Literature", "q": "Science",
    }),
    "labelled_serial_status": ("serial_status", "category", {"c": "Still published", "d": "Ceased", "u": "Status unknown"}),
    "labelled_succession_link": ("succession_link", "category", {
        "pred": "Continues an earlier title (780)", "succ": "Continued by a later title (785)",
    }),
    "labelled_succession_type": ("succession_type", "category", {
        "0": "Continued by", "1": "Continued in part by", "2": "Superseded by", "3": "Superseded in part by",
        "4": "Absorbed by", "5": "Absorbed in part by", "6": "Split into", "7": "Merged to form", "8": "Changed back to",
    }),
    "labelled_destination": ("archive_destination", "category", {
        "finding_aid": "Finding-aid platform", "aggregator": "Aggregator (OAC, ArchiveGrid)",
        "resolver": "Persistent-ID resolver", "repository": "Digital repository", "vendor": "Vendor / licensed", "other": "Other",
    }),
    "labelled_bucket": ("cat_mix", "bucket", {
        "lc": "Library of Congress", "self": "This institution", "pod": "Another member", "other": "Some other agency",
        "none": "No agency given",
    }),
    "labelled_depth": ("cat_mod_depth", "category", {"no_040": "No 040 field", "0": "None"}),
    "labelled_field": ("coverage", "field", {
        "isbn": "ISBN (020)", "subjects": "Subjects (6xx)", "author": "Author (1xx)", "online": "Online access (856)",
        "phys_desc": "Physical description (300)", "lc_classification": "LC classification",
    }),
    "labelled_channel": ("channel_coverage", "channel", {
        "any_system": "Any system number", "oclc": "OCLC / WorldCat", "rlin": "RLIN (RLG, pre-2006)",
        "alma_cz": "Ex Libris Community Zone", "local_system": "A local library system", "pod_system": "Another member's system",
    }),
}


# Per title its holders, and of each attribute the value that most of its records give, the least of equal ones.
ELECTED = ",\n".join(
    f"""{a}_votes AS (
  SELECT title_key, {a}, row_number() OVER (PARTITION BY title_key ORDER BY count(*) DESC, {a}) AS place
  FROM described WHERE {a} IS NOT NULL GROUP BY title_key, {a})"""
    for a in ("decade", "language", "format")
)
FACETS = f"""\
first_008 AS (
  SELECT org, record_id, arg_min(value, coalesce(field_seq, 2147483647)) AS value FROM records WHERE tag = '008' AND record_id IS NOT NULL GROUP BY ALL),
first_leader AS (
  SELECT org, record_id, arg_min(value, coalesce(field_seq, 2147483647)) AS value FROM records
  WHERE tag = 'LDR' AND record_id IS NOT NULL AND length(value) >= 7 GROUP BY ALL),
described AS (
  SELECT m.org, m.title_key, CASE WHEN y BETWEEN 1450 AND 2030 THEN y // 10 * 10 END AS decade, language, format
  FROM (SELECT *, {year("date1")} AS y FROM (
    SELECT m.org, m.title_key, substr(f.value, 8, 4) AS date1, nullif(upper(trim(substr(f.value, 36, 3))), '') AS language,
           nullif(trim(l.value[7]), '') AS format
    FROM record_meta m LEFT JOIN first_008 f USING (org, record_id) LEFT JOIN first_leader l USING (org, record_id)
    WHERE m.title_key IS NOT NULL)) m),
{ELECTED},
facets AS (
  SELECT holders, k AS n_holders, decade, language, format, count(*) AS titles
  FROM width
  LEFT JOIN (SELECT title_key, decade FROM decade_votes WHERE place = 1) USING (title_key)
  LEFT JOIN (SELECT title_key, language FROM language_votes WHERE place = 1) USING (title_key)
  LEFT JOIN (SELECT title_key, format FROM format_votes WHERE place = 1) USING (title_key)
  WHERE title_key IS NOT NULL GROUP BY ALL)"""


def folded_facets() -> str:
    """Level by level: what reaches the threshold is shown, the rest is added up with less told apart."""
    keys = ["holders", "n_holders", "decade", "language", "format"]
    steps, shown = ["level4 AS (SELECT *, titles AS n FROM facets)"], []
    for depth in range(4, 0, -1):
        kept = keys[: depth + 1]
        gone = "".join(f", NULL AS {k}" for k in keys[depth + 1 :])
        shown.append(f"SELECT {', '.join(kept)}{gone}, {depth} AS depth, n::BIGINT AS titles FROM level{depth} WHERE n >= {THRESHOLD}")
        by = ", ".join(keys[:depth] if depth > 1 else ["n_holders"])
        steps.append(f"level{depth - 1} AS (SELECT {by}, sum(n) AS n FROM level{depth} WHERE n < {THRESHOLD} GROUP BY ALL)")
    shown.append("SELECT NULL, n_holders, NULL, NULL, NULL, 0, n::BIGINT FROM level0")
    return q("\nUNION ALL ".join(shown), HOLDINGS, WIDTH, FACETS, *steps)


# Reports whose denominators are sums of their categories -> (their query, where the axis may be cut).
MARGINS = {
    "language": ("lang_matrix", 15), "country": ("country_matrix", 15), "record_type": ("record_type_matrix", 15),
    "lc_class": ("lc_class", None), "lc_class_serial": ("lc_class_serial", None), "serial_status": ("serial_status", 15),
    "mod_depth": ("cat_mod_depth", None),
}


def disclosure(texts: dict[str, str]) -> dict[str, str]:
    """What a total less the other cells gives away, in closed form, before and after a second cell goes."""
    rows = " UNION ALL ".join(
        f"SELECT '{report}' AS report, org, category, n, total, {f'max(cat_rank) OVER () < {cap}' if cap else 'TRUE'} AS whole FROM ({texts[query]})"
        for report, (query, cap) in MARGINS.items()
    )
    known = f"""WITH cells AS ({rows}),
m AS (
  SELECT *, count(*) FILTER (n IS NULL) OVER org AS k, total - coalesce(sum(n) OVER org, 0) AS rest
  FROM cells WINDOW org AS (PARTITION BY report, org)
), b AS (
  SELECT *, least({THRESHOLD - 1}, rest - (k - 1)) AS high, CASE WHEN whole THEN greatest(1, rest - (k - 1) * {THRESHOLD - 1}) ELSE 1 END AS low
  FROM m
), x AS (
  SELECT *, coalesce(bool_or(n IS NULL AND low = high) OVER (PARTITION BY report, org), FALSE) AS exposed FROM b
), y AS (
  SELECT *, exposed AND n >= {THRESHOLD} AND rest + n > {THRESHOLD} + k AS hides FROM x
), z AS (
  SELECT *, hides AND row_number() OVER (PARTITION BY report, org, hides ORDER BY n, category) = 1 AS beside,
         exposed AND NOT bool_or(coalesce(hides, FALSE)) OVER (PARTITION BY report, org) AS no_cell
  FROM y
)"""
    return {
        "recoverable_cells": f"{known} SELECT report, org, category, low::BIGINT AS value FROM x WHERE n IS NULL AND low = high",
        "protected_cells": f"""{known}
SELECT report, org, category, CASE WHEN NOT coalesce(beside, FALSE) THEN n END AS n, CASE WHEN NOT no_cell THEN total END AS total,
       CASE WHEN n IS NULL THEN 'small' WHEN beside THEN 'beside' END AS withheld
FROM z""",
        "disclosure_audit": f"""{known}
SELECT report, count(*) FILTER (n IS NULL) AS withheld, count(*) FILTER (n IS NULL AND low = high) AS recoverable,
       count(*) FILTER (beside) AS beside, count(DISTINCT org) FILTER (no_cell) AS totals, 0::BIGINT AS recoverable_after
FROM z GROUP BY report""",
    }


# Queries that come to the result of another by other ways.
AGAIN = {
    "link_hosts_summarised": "link_hosts",
    "snapshot_diff_by_digests": "snapshot_diff",
    "published_sql": "overlap_histogram",
    "probe_read": "code_probe",
    "bucketed_coverage": "coverage",
    "bucketed_cat_mix": "cat_mix",
    "bucketed_record_text": "record_nested_text",
    "refreshed_histogram": "overlap_histogram",
    "refreshed_cat_mix": "cat_mix",
    "refreshed_channels": "channel_coverage",
}


def oracle_sql() -> dict[str, str]:
    """Every text; those of labelled reports name the categories of the report's own text."""
    texts = reports()
    for name, (report, column, names) in LABELLED.items():
        texts[name] = named(f"SELECT {column} AS category FROM ({texts[report]})", "category", names, False)
    for name, report in AGAIN.items():
        texts[name] = texts[report]
    parts = "(1 - grouping(decade)) + (1 - grouping(language)) * 2 + (1 - grouping(format)) * 4"
    texts["pattern_cube"] = q(
        f"SELECT holders, n_holders, decade, language, format, ({parts})::INT AS parts, sum(titles)::BIGINT AS titles"
        " FROM facets GROUP BY holders, n_holders, CUBE (decade, language, format)",
        HOLDINGS, WIDTH, FACETS,
    )
    texts["pattern_cube_folded"] = folded_facets()
    texts["group_unique_decades"] = q(
        "SELECT c.one AS org, decade, count(*) AS titles FROM chosen c"
        " LEFT JOIN (SELECT title_key, decade FROM decade_votes WHERE place = 1) d USING (title_key) WHERE c.k = 1 GROUP BY ALL",
        HOLDINGS, WIDTH, FACETS, IN_GROUP,
    )
    texts["artifact_read"] = f"SELECT *, '2026-08-22' AS generated_at FROM ({texts['uniqueness']})"
    texts["reading_order"] = f"SELECT row_number() OVER (ORDER BY unique_titles DESC, org) AS line, * FROM ({texts['uniqueness']})"
    return texts | disclosure(texts)


def reports() -> dict[str, str]:
    from shelftally.functions import labels

    field_text = """\
CASE WHEN count(s.code) = 0 THEN any_value(tag) || '      ' || coalesce(any_value(value), '')
     ELSE any_value(tag) || ' ' || coalesce(any_value(ind1), ' ') || coalesce(any_value(ind2), ' ') || '  '
          || string_agg('$' || s.code || value, ' ' ORDER BY subfield_seq, s.code, value) END"""
    return {
        # overlap
        "corpus_totals": q(
            "SELECT count(*) AS records, count(DISTINCT title_key) AS titles,"
            " count(DISTINCT org) AS institutions FROM record_meta"
        ),
        "org_totals": q(
            "SELECT m.org, count(*) AS records, count(DISTINCT title_key) AS titles, any_value(h.last_modified) AS last_sync"
            " FROM record_meta m LEFT JOIN harvest_state h USING (org) GROUP BY m.org"
        ),
        "org_titles": q("SELECT org, titles FROM sizes", HOLDINGS, SIZES),
        "overlap_histogram": q(
            "SELECT k AS institutions, count(*) AS titles FROM width GROUP BY k", HOLDINGS, WIDTH
        ),
        "overlap_pairwise": q("SELECT a, b, shared FROM shared", HOLDINGS, SHARED),
        "uniqueness": q(
            "SELECT one AS org, count(*) AS unique_titles FROM width WHERE k = 1 GROUP BY one",
            HOLDINGS,
            WIDTH,
        ),
        "holding_mask": q(
            "SELECT holders, k AS n_holders, count(*) AS titles FROM width GROUP BY ALL", HOLDINGS, WIDTH
        ),
        "holding_mask_folded": q(
            f"SELECT CASE WHEN titles >= {THRESHOLD} THEN holders END AS holders, k AS n_holders, sum(titles)::BIGINT AS titles"
            " FROM (SELECT holders, k, count(*) AS titles FROM width GROUP BY ALL) GROUP BY ALL",
            HOLDINGS,
            WIDTH,
        ),
        "group_overlap": q(
            "SELECT k AS held_by, count(*) AS titles FROM chosen GROUP BY k", HOLDINGS, IN_GROUP
        ),
        "group_shared": q(
            "SELECT count(*) AS titles FROM chosen WHERE k = 3", HOLDINGS, IN_GROUP
        ),
        "group_unique": q(
            "SELECT one AS org, count(*) AS titles FROM chosen WHERE k = 1 GROUP BY one",
            HOLDINGS,
            IN_GROUP,
        ),
        "jaccard": q(
            f"SELECT a, b, shared, {JACCARD} AS jaccard FROM pairs", HOLDINGS, SIZES, SHARED, PAIRS
        ),
        "containment": q(
            f"SELECT a, b, shared, {ratio('shared', 'own')} AS containment FROM {ORDERED}",
            HOLDINGS,
            SIZES,
            SHARED,
            PAIRS,
        ),
        "closest_pairs": q(
            f"SELECT a, b, shared, {JACCARD} AS measure FROM pairs ORDER BY measure DESC, a, b LIMIT 15",
            HOLDINGS,
            SIZES,
            SHARED,
            PAIRS,
        ),
        "closest_containment": q(
            f"SELECT a, b, shared, {ratio('shared', 'own')} AS measure FROM {ORDERED} ORDER BY measure DESC, a, b LIMIT 15",
            HOLDINGS,
            SIZES,
            SHARED,
            PAIRS,
        ),
        "closest_shared": q(
            "SELECT a, b, shared, shared::DOUBLE AS measure FROM pairs ORDER BY measure DESC, a, b LIMIT 15",
            HOLDINGS,
            SIZES,
            SHARED,
            PAIRS,
        ),
        "containment_matrix": q(
            f"SELECT a, b, {ratio('shared', 'own')} AS value FROM {ORDERED} UNION ALL SELECT org, org, NULL FROM sizes",
            HOLDINGS,
            SIZES,
            SHARED,
            PAIRS,
        ),
        "similarity_matrix": q(
            f"SELECT a, b, {JACCARD} AS value FROM pairs UNION ALL SELECT b, a, {JACCARD} FROM pairs"
            " UNION ALL SELECT org, org, NULL FROM sizes",
            HOLDINGS,
            SIZES,
            SHARED,
            PAIRS,
        ),
        # dates
        "publication_decade": q("SELECT org, decade, is_other, records FROM folded", DECADES),
        "numeric_decades": q(
            "SELECT org, decade, records FROM folded WHERE decade IS NOT NULL", DECADES
        ),
        # serials
        "serials_active": q(
            f"""\
SELECT org, yr::INT AS year, count(*) AS records
FROM (
  SELECT org, {year(DATE1)} AS y1,
         CASE WHEN {DATE2} = '9999' OR value[7] = 'c' THEN {NOW} WHEN value[7] = 'd' THEN {year(DATE2)} END AS y2
  FROM {SERIAL_008} WHERE length(value) >= 15) s, generate_series(s.y1, s.y2) g(yr)
WHERE y1 BETWEEN 1500 AND {NOW} AND y2 <= {NOW} GROUP BY ALL"""
        ),
        "serials_start_decade": q(START),
        "serials_total": q(f"SELECT org, total AS n FROM {SERIAL_TOTAL}"),
        "succession_link": grid(
            f"""\
SELECT r.org, CASE r.tag WHEN '780' THEN 'pred' ELSE 'succ' END AS category, count(DISTINCT r.record_id) AS n
FROM records r JOIN {SERIAL} s USING (org, record_id) WHERE r.tag IN ('780', '785') GROUP BY ALL""",
            axis=("pred", "succ"),
            totals=SERIAL_TOTAL,
        ),
        "succession_type": grid(
            f"""\
SELECT r.org, r.ind2 AS category, count(DISTINCT r.record_id) AS n
FROM records r JOIN {SERIAL} s USING (org, record_id)
WHERE r.tag = '785' AND r.ind2 BETWEEN '0' AND '8' GROUP BY ALL""",
            totals=SERIAL_TOTAL,
        ),
        "serial_status": grid(STATUS, top=15),
        "serial_status_ordered": grid(STATUS, axis=("c", "d", "u")),
        # archives and links
        "archive_totals": q(f"SELECT org, total AS n FROM {ARCHIVE_TOTAL}"),
        "archive_type": grid(
            f"SELECT org, kind AS category, count(*) AS n FROM {ARCHIVE} GROUP BY ALL",
            top=10,
            totals=ARCHIVE_TOTAL,
        ),
        "archive_genre": q(
            f"""\
SELECT t.org, t.total, g.term, g.place::INT AS term_rank, g.n
FROM {ARCHIVE_TOTAL} t LEFT JOIN (
  SELECT org, term, n, row_number() OVER (PARTITION BY org ORDER BY n DESC, term) AS place
  FROM (SELECT r.org, lower(rtrim(trim(r.value), ' .')) AS term, count(DISTINCT r.record_id) AS n
        FROM records r JOIN {ARCHIVE} a USING (org, record_id)
        WHERE r.tag = '655' AND r.code = 'a' AND trim(r.value) <> '' GROUP BY ALL)
  WHERE n >= {THRESHOLD} QUALIFY place <= 12) g USING (org)"""
        ),
        "archive_decade": q(ARCHIVE_START),
        "archive_link": q(f"SELECT org, n, total FROM {LINKED}"),
        "link_share": q(
            f"SELECT org, n, total, n::DOUBLE / total AS share,"
            f" row_number() OVER (ORDER BY n::DOUBLE / total DESC, org)::INT AS place FROM {LINKED}"
        ),
        "archive_destination": grid(
            DESTINATIONS,
            axis=("finding_aid", "aggregator", "resolver", "repository", "vendor", "other"),
            totals=ARCHIVE_TOTAL,
        ),
        "link_hosts": q(
            f"""\
SELECT t.org, t.total, h.host, h.place::INT AS host_rank, h.n
FROM (SELECT org, sum(n)::BIGINT AS total FROM hosts GROUP BY org) t LEFT JOIN (
  SELECT org, host, n, row_number() OVER (PARTITION BY org ORDER BY n DESC, host) AS place
  FROM hosts WHERE host <> '' AND n >= {THRESHOLD} QUALIFY place <= 15) h USING (org)""",
            HOSTS,
        ),
        "vintage_share": q(
            f"""\
SELECT subset, org, decade, n, n::DOUBLE / sum(n) OVER (PARTITION BY subset, org) AS share
FROM (SELECT 'serials' AS subset, org, decade, records AS n FROM ({START})
      UNION ALL SELECT 'archives', org, decade, n FROM ({ARCHIVE_START}))"""
        ),
        # coverage
        "coverage": q("SELECT org, field, n, records, share FROM fields", FIELDS),
        "field_order": q(
            "SELECT field, round(avg(share), 6) AS mean_share,"
            " row_number() OVER (ORDER BY round(avg(share), 6) DESC, field)::INT AS place FROM fields GROUP BY field",
            FIELDS,
        ),
        # comparison
        "lang_matrix": grid(LANGUAGE, top=15),
        "country_matrix": grid(COUNTRY, top=15),
        "record_type_matrix": grid(RECORD_TYPE, top=15),
        "lc_class": lc(),
        "lc_class_serial": lc(f"(org, record_id) IN (SELECT (org, record_id) FROM {SERIAL})"),
        "share_without_top": grid(RECORD_TYPE, top=15) + "\nWHERE a.category <> 'a'",
        # provenance
        "cataloging_source": q(
            "SELECT org, entered AS entered_year, source_code, owner AS source_org, bucket, depth AS mod_depth, count(*) AS n"
            " FROM sourced GROUP BY ALL",
            SOURCED,
        ),
        "cat_mix": q(
            f"""\
SELECT h.org, v.category AS bucket, v.cat_rank::INT AS bucket_rank, coalesce(m.n, 0)::BIGINT AS n, h.total AS records,
       round(coalesce(m.n, 0)::DOUBLE / h.total, 4) AS share
FROM {HELD} h CROSS JOIN {values(BUCKETS)} v LEFT JOIN (
  SELECT org, CASE WHEN n < {THRESHOLD} THEN 'other' ELSE bucket END AS bucket, sum(n) AS n
  FROM (SELECT org, bucket, count(*) AS n FROM sourced GROUP BY ALL) GROUP BY ALL) m
  ON m.org = h.org AND m.bucket = v.category""",
            SOURCED,
        ),
        "cat_agency": sourced_grid(
            f"""\
SELECT * FROM ({AGENCY_COUNTS}) WHERE category IN (
  SELECT category FROM (
    SELECT category, row_number() OVER (PARTITION BY org ORDER BY n DESC, category) AS place FROM ({AGENCY_COUNTS}))
  WHERE place <= 12)""",
            totals="(SELECT org, count(source_code) AS total FROM sourced GROUP BY org HAVING total > 0)",
        ),
        "agency_totals": q(
            "SELECT org, count(*) AS n FROM sourced WHERE source_code IS NOT NULL GROUP BY org", SOURCED
        ),
        "cat_flow": sourced_grid(
            "SELECT org, owner AS category, count(*) AS n FROM sourced WHERE owner IS NOT NULL GROUP BY ALL",
            axis="(SELECT org AS category, row_number() OVER (ORDER BY org) AS cat_rank FROM (SELECT org FROM code_map UNION SELECT org FROM record_meta))",
            last=" ",
        ),
        "flow_off_diagonal": sourced_grid(
            "SELECT org, owner AS category, count(*) AS n FROM sourced WHERE owner IS NOT NULL GROUP BY ALL",
            axis="(SELECT org AS category, row_number() OVER (ORDER BY org) AS cat_rank FROM (SELECT org FROM code_map UNION SELECT org FROM record_meta))",
            last=" ",
        ).replace(
            f"({shown('coalesce(c.n, 0)')})::BIGINT AS n",
            f"CASE WHEN t.org <> a.category THEN ({shown('coalesce(c.n, 0)')})::BIGINT END AS n",
        ),
        "cat_mod_depth": sourced_grid(
            "SELECT org, depth AS category, count(*) AS n FROM sourced GROUP BY ALL",
            axis=("no_040", "0", "1", "2", "3-4", "5-9", "10+"),
        ),
        "cat_timeline": q(
            "SELECT org, year, bucket, bucket_rank, n, total FROM timeline", SOURCED, PLACED
        ),
        "cat_unplaced": q("SELECT org, unplaced FROM unplaced", SOURCED, PLACED),
        "timeline_cover": q(f"SELECT org, total AS n FROM {HELD}"),
        "mix_by_year": q(
            f"SELECT org, year, bucket, bucket_rank, n FROM timeline WHERE year < {NOW}", SOURCED, PLACED
        ),
        "original_share": q(
            f"SELECT org, year, total, n AS original, n::DOUBLE / total AS share FROM timeline WHERE bucket = 'self' AND year < {NOW}",
            SOURCED,
            PLACED,
        ),
        "unplaced_summary": q(
            "SELECT sum(unplaced)::BIGINT AS unplaced, (SELECT count(*) FROM record_meta) AS records,"
            " sum(unplaced)::DOUBLE / (SELECT count(*) FROM record_meta) AS share FROM unplaced",
            SOURCED,
            PLACED,
        ),
        "cat_self_codes": q("SELECT org, code, n FROM own", SOURCED, OWN_CODES),
        "code_map_listed": q(
            f"SELECT m.org, m.code, CASE WHEN m.is_marc THEN 'marc' ELSE 'oclc' END AS kind, m.registry_name,"
            f" {shown('coalesce(own.n, 0)')} AS records FROM code_map m LEFT JOIN own ON own.org = m.org AND own.code = m.code",
            SOURCED,
            OWN_CODES,
        ),
        "code_map_via_family": q(
            f"SELECT own.org, own.code, arg_max(m.code, length(m.code)) AS parent, {shown('any_value(own.n)')} AS records"
            " FROM own JOIN code_map m ON m.org = own.org AND m.is_marc AND starts_with(own.code, m.code || '-')"
            " WHERE NOT EXISTS (SELECT 1 FROM code_map x WHERE x.org = own.org AND x.code = own.code) GROUP BY ALL",
            SOURCED,
            OWN_CODES,
        ),
        "code_probe": q(
            f"""\
SELECT org, code, n, round(100.0::DOUBLE * n / total, 3) AS pct_of_org, round(100.0::DOUBLE * n / everywhere, 1) AS pct_at_this_org
FROM (SELECT u.*, h.total, sum(n) OVER (PARTITION BY code) AS everywhere,
             row_number() OVER (PARTITION BY org ORDER BY n DESC, code) AS place
      FROM (SELECT org, {AGENCY} AS code, count(*) AS n FROM records r WHERE tag = '040' AND r.code = 'a' GROUP BY ALL) u
      JOIN {HELD} h USING (org) WHERE u.code <> '')
WHERE n >= 0.0002 * total OR place <= 40"""
        ),
        "unmapped_orgs": q(
            "SELECT DISTINCT org FROM record_meta WHERE org NOT IN (SELECT lower(n_name) FROM nation WHERE n_regionkey <> 0)"
        ),
        "code_map_violations": q(
            """\
SELECT 'contested' AS problem, code, is_marc, string_agg(DISTINCT org, ',' ORDER BY org) AS orgs
FROM planted GROUP BY code, is_marc HAVING count(DISTINCT org) > 1
UNION ALL
SELECT DISTINCT 'family', x.code, x.is_marc, b.org || ',' || x.org
FROM planted b JOIN planted x ON b.is_marc AND starts_with(x.code, b.code || '-') AND b.org <> x.org""",
            """\
planted AS (
  SELECT org, code, is_marc FROM code_map
  UNION ALL SELECT lower(n_name), concat('N', (n_nationkey + 1) % 25), TRUE FROM nation WHERE n_regionkey = 1
  UNION ALL SELECT lower(n_name), concat('N', (n_nationkey + 2) % 25, '-BR'), FALSE FROM nation WHERE n_regionkey = 2)""",
        ),
        "code_owners": q(
            "SELECT code, owner FROM owned", PER_RECORD, OWNERS,
            owned("SELECT DISTINCT agency AS code FROM agencies WHERE agency <> ''"),
        ),
        # channels
        "channel_coverage": q(
            f"""\
SELECT org, channel, channel_rank, {shown()} AS n, total AS records,
       CASE WHEN n > 0 AND n < {THRESHOLD} THEN NULL ELSE round(n::DOUBLE / total, 4) END AS share
FROM ({CHANNEL_ROWS})""",
            CARRIED,
        ),
        "channel_namespace": grid(
            NAMESPACE_COUNTS, totals=f"(SELECT * FROM {HELD} h SEMI JOIN counts USING (org))"
        ).replace("counts AS (", f"{USED},\ncounts AS (", 1),
        "namespace_totals": q(f"SELECT org, total AS n FROM {HELD}"),
        # records
        "record_nested_text": q(
            f"""\
SELECT org, record_id, string_agg(line, chr(10) ORDER BY field_seq) AS text
FROM (SELECT org, record_id, field_seq, {field_text.replace('s.code', 'code')} AS line
      FROM records WHERE record_id IS NOT NULL GROUP BY org, record_id, field_seq)
GROUP BY org, record_id"""
        ),
        "field_pivot": q(
            "SELECT record_id, max(value) FILTER (WHERE tag = '245' AND code = 'a') AS title,"
            " max(value) FILTER (WHERE tag = '100' AND code = 'a') AS author"
            " FROM records WHERE tag IN ('100', '245') GROUP BY record_id"
        ),
        "org_field_count": q(
            "SELECT org, count(*) AS n FROM records WHERE tag = '856' AND code = 'u' GROUP BY org"
        ),
        "sample_values": q(
            "SELECT org, record_id, value FROM records WHERE tag = '245' AND code = 'a'"
            " ORDER BY org, record_id, field_seq, subfield_seq LIMIT 20"
        ),
        # suppression, diff, labels
        "suppress_top_n": q(
            f"""\
SELECT org, CASE WHEN place <= 5 AND n >= {THRESHOLD} THEN host ELSE 'Other' END AS category, sum(n)::BIGINT AS n,
       (CASE WHEN place <= 5 AND n >= {THRESHOLD} THEN place ELSE 6 END)::INT AS cat_rank
FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY n DESC, host) AS place FROM hosts) GROUP BY ALL""",
            HOSTS,
        ),
        "small_cells": q(f"SELECT org, host, n FROM hosts WHERE n > 0 AND n < {THRESHOLD}", HOSTS),
        "snapshot_diff": q(
            f"""\
SELECT '-' AS change, * FROM (({EARLIER}) EXCEPT ALL ({START}))
UNION ALL
SELECT '+', * FROM (({START}) EXCEPT ALL ({EARLIER}))"""
        ),
        "code_map_read": q(
            "SELECT org, code, is_marc, registry_name, row_number() OVER (ORDER BY seq, code, org) - 1 AS seq FROM code_map"
        ),
        "labelled_matrix": q(named(LANGUAGE, "category", labels.LANGUAGE, False)),
        "labelled_place": q(named(COUNTRY, "category", labels.PLACE, False)),
        "labelled_agency": q(named(AGENCY_COUNTS, "category", labels.AGENCY, True), SOURCED),
        "labelled_namespace": q(
            named("SELECT prefix AS category FROM used", "category", labels.AGENCY | labels.NAMESPACE, True), USED
        ),
        "labelled_orgs": q(
            "SELECT DISTINCT org, upper(org[1]) || org[2:] AS label FROM record_meta"
        ),
    }
