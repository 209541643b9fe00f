"""
Scalar expressions over one subfield ``value``, as Spark SQL text.

Text rather than Column objects because the queries that use them are published, as
run, next to their results; ``F.expr(...)`` turns any of them into a Column.
Character positions are 1-based, as in the catalogue format itself.
"""

from shelftally.functions import vocab


def literal(text: str) -> str:
    """A Spark SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    escaped = "".join(c if 31 < ord(c) < 127 else f"\\u{ord(c):04X}" for c in escaped)
    return f"'{escaped}'"


def in_list(values) -> str:
    return "(" + ", ".join(literal(v) for v in values) + ")"


# Unicode space separators, which a bare trim in the checked results also removes.
SPACES = "\u0020\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
# White space of every kind, as around hand-edited values.
WHITE = SPACES + "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f\u0085\u2028\u2029"
# What surrounds an agency code in real records.
CODE_NOISE = " *.,;:\t\n\r\u00a0"


# --- fixed positions ---------------------------------------------------------

DATE_TYPE = (7, 1)
DATE_1 = (8, 4)
DATE_2 = (12, 4)
PLACE = (16, 3)
LANGUAGE = (36, 3)
RECORD_TYPE = (7, 1)
BIB_LEVEL = (8, 1)
ENTERED = (1, 6)


def piece(position: tuple[int, int], column: str = "value") -> str:
    start, length = position
    return f"substring({column}, {start}, {length})"


def stripped(text: str) -> str:
    return f"btrim({text}, {literal(SPACES)})"


# --- years -------------------------------------------------------------------


def year(text: str) -> str:
    """Four digits as a number, anything else NULL (never an ANSI cast failure)."""
    return f"CASE WHEN {text} RLIKE '^[0-9]{{4}}$' THEN try_cast({text} AS INT) END"


def decade(number: str) -> str:
    return f"({number} div 10) * 10"


def entered_year(stamp: str, now_year: int) -> str:
    """Year of a ``yymmdd`` entry date; the all-zero placeholder has none."""
    yy = f"try_cast(substring({stamp}, 1, 2) AS INT)"
    pivot = now_year % 100
    this_century = now_year - pivot
    return (
        f"CASE WHEN {stamp} RLIKE '^[0-9]{{6}}$' AND {stamp} <> '000000'"
        f" THEN {yy} + if({yy} <= {pivot}, {this_century}, {this_century - 100}) END"
    )


# --- codes, namespaces, terms ------------------------------------------------


def agency_code(column: str = "value") -> str:
    """An agency code without the noise around it, upper-cased."""
    return f"upper(btrim({column}, {literal(CODE_NOISE)}))"


def namespace(column: str = "value") -> str:
    """The ``(NAMESPACE)`` at the head of a system control number, '' if there is none."""
    head = rf"regexp_extract({column}, r'^[ \t\n\f\r]*\(([^)]{{1,24}})\)', 1)"
    return f"upper({stripped(head)})"


def genre_term(column: str = "value") -> str:
    """A genre heading, lower-cased, without surrounding space or closing punctuation."""
    return f"lower(trim(TRAILING ' .' FROM {stripped(column)}))"


def link_host(column: str = "value") -> str:
    return f"regexp_extract(lower({column}), 'https?://([^/]+)', 1)"


def is_link(column: str = "value") -> str:
    """Case-sensitive on purpose: only a lower-case scheme counts as a link."""
    return f"startswith({column}, 'http')"


def destination(host: str) -> str:
    """Kind of site a link host belongs to; the first kind that matches wins."""
    arms = " ".join(
        f"WHEN {host} RLIKE r'{pattern}' THEN '{kind}'" for kind, pattern in vocab.DESTINATIONS
    )
    return f"CASE {arms} ELSE 'other' END"


def country(place: str) -> str:
    """A place code rolled up to its country where the roll-up lists it."""
    arms = " ".join(f"WHEN {place} IN {in_list(codes)} THEN '{name}'" for name, codes in vocab.PLACE_ROLLUP.items())
    return f"CASE {arms} ELSE {place} END"


# --- call numbers ------------------------------------------------------------


def call_number_rank() -> str:
    """Priority of the location a row holds a call number in, NULL elsewhere."""
    arms = " ".join(
        f"WHEN tag = '{tag}' AND code = '{code}'"
        + (f" AND ind1 = '{ind1}'" if ind1 else "")
        + f" THEN {rank}"
        for rank, (tag, code, ind1) in enumerate(vocab.CALL_NUMBER_LOCATIONS)
    )
    return f"CASE {arms} END"


CALL_NUMBER_TAGS = in_list(sorted({tag for tag, _, _ in vocab.CALL_NUMBER_LOCATIONS}))


def is_lc_shaped(column: str = "value") -> str:
    """Leads with a letter the scheme uses, and is not a medical QS-QZ number."""
    head = f"upper(substring({stripped(column)}, 1, 2))"
    return f"{head} RLIKE '^(?!Q[S-Z])[A-HJ-NP-VZ]'"


def lc_class(column: str = "value") -> str:
    return f"upper(substring({stripped(column)}, 1, 1))"


def place_in_record(*, top: str = "0", payload: str = "0") -> str:
    """
    One number that orders rows by ``top``, then field, then subfield, and carries a byte
    along. A minimum over it needs no sort, since a decimal has a fixed width. Every INT
    has room in it, negative ones too; rows without a position come last.
    """

    def place(column: str) -> str:
        return f"coalesce(CAST({column} AS DECIMAL(38, 0)) + 2147483648, 4294967296)"

    whole = f"CAST({top} AS DECIMAL(38, 0))"
    for column in ("field_seq", "subfield_seq"):
        whole = f"({whole} * 8589934592 + {place(column)})"
    return f"({whole} * 256 + {payload})"


def sequence(column: str) -> str:
    """A position to order by, where rows without one come last."""
    return f"coalesce({column}, 2147483647)"


# --- provenance --------------------------------------------------------------


def origin_bucket(code: str, owner: str, holder: str) -> str:
    """Who made the description, as seen from the holder: the first bucket whose test holds."""
    tests = {
        "none": f"{code} IS NULL",
        "lc": f"split_part({code}, '-', 1) = {literal(vocab.NATIONAL_AGENCY)}",
        "self": f"{owner} = {holder}",
        "pod": f"{owner} IS NOT NULL",
    }
    named = ", ".join(f"if({test}, '{bucket}', NULL)" for bucket, test in tests.items())
    return f"coalesce({named}, 'other')"


def modification_depth(has_field: str, agencies: str) -> str:
    """The deepest bucket whose floor the number of agencies reaches."""
    names = ", ".join(map(literal, vocab.DEPTH_FLOORS))
    reached = " + ".join(f"CAST({agencies} >= {floor} AS INT)" for floor in vocab.DEPTH_FLOORS.values())
    return f"if({has_field}, element_at(array({names}), {reached}), {literal(vocab.NO_FIELD)})"


def channel_tests(prefix: str, owner: str, holder: str) -> dict[str, str]:
    """One test per channel a control number can show; they overlap."""

    def test(channel: str) -> str:
        ways = []
        if channel in vocab.CHANNEL_NAMESPACES:
            ways.append(f"{prefix} LIKE ANY {in_list(vocab.CHANNEL_NAMESPACES[channel])}")
        if channel in vocab.CHANNEL_OWNERS:
            ways.append(f"coalesce({owner} {vocab.CHANNEL_OWNERS[channel]} {holder}, false)")
        return " OR ".join(ways)

    return {channel: test(channel) for channel in vocab.CHANNELS}


# --- published numbers -------------------------------------------------------


def published(count: str, threshold: int) -> str:
    """The count, or NULL where it is too small to publish; a true zero stays."""
    return f"CASE WHEN {count} = 0 OR {count} >= {threshold} THEN {count} END"


def share(part: str, whole: str) -> str:
    """Share to four places, 0 on an empty denominator."""
    return f"CASE WHEN {whole} = 0 THEN 0D ELSE round({part} / CAST({whole} AS DOUBLE), 4) END"
