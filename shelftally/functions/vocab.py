"""Fixed values the published figures depend on, stated as data."""

# (tag, subfield, required first indicator), in priority order.
CALL_NUMBER_LOCATIONS = (
    ("050", "a", None),
    ("090", "a", None),
    ("852", "h", "0"),
    ("950", "a", None),
    ("900", "f", None),
    ("099", "a", None),
    ("949", "a", None),
)

# (kind, pattern over the host), first match wins; 'other' is what is left.
DESTINATIONS = (
    ("finding_aid", r"findingaid|archives"),
    ("aggregator", r"\A(www\.)?oac\.cdlib\.org\z|archivegrid|snaccooperative"),
    ("resolver", r"\A(nrs|arks|purl|hdl|handle)\.|doi\.org\z"),
    ("vendor", r"proquest|amdigital|gale|jstor|e-enlightenment"),
    ("repository", r"colenda|digital|repository|dspace|fedora|idn\.duke"),
)
# The order the kinds are published in.
DESTINATION_ORDER = (
    "finding_aid",
    "aggregator",
    "resolver",
    "repository",
    "vendor",
    "other",
)

# Place codes of a country's parts, by the code of the country, and fills that mean "unknown".
PLACE_ROLLUP = {
    "XXU": (
        "XXU", "ALU", "AKU", "AZU", "ARU", "CAU", "COU", "CTU", "DCU", "DEU", "FLU", "GAU",
        "HIU", "IDU", "ILU", "INU", "IAU", "KSU", "KYU", "LAU", "MEU", "MDU", "MAU", "MIU",
        "MNU", "MSU", "MOU", "MTU", "NBU", "NVU", "NHU", "NJU", "NMU", "NYU", "NCU", "NDU",
        "OHU", "OKU", "ORU", "PAU", "RIU", "SCU", "SDU", "TNU", "TXU", "UTU", "VTU", "VAU",
        "WAU", "WVU", "WIU", "WYU",
    ),
    "XXC": (
        "XXC", "ABC", "BCC", "MBC", "NKC", "NFC", "NSC", "NTC", "NUC", "ONC", "PIC", "QUC",
        "SNC", "YKC",
    ),
    "XXK": (
        "XXK", "ENK", "STK", "WLK", "NIK", "UIK",
    ),
    "XX": ("UUU",),
}

ARCHIVE_TYPES = ("t", "d", "f", "p")
ARCHIVE_LEVELS = ("c", "d")
SERIAL_STATUSES = ("c", "d", "u")
SUCCESSION_LINKS = {"pred": "780", "succ": "785"}
SUCCESSION_TYPES = ("0", "1", "2", "3", "4", "5", "6", "7", "8")

ORIGIN_BUCKETS = ("lc", "self", "pod", "other", "none")
# The agency that counts as lc, its branches behind a hyphen included.
NATIONAL_AGENCY = "DLC"
# The least number of modifying agencies of each depth.
DEPTH_FLOORS = {"0": 0, "1": 1, "2": 2, "3-4": 3, "5-9": 5, "10+": 10}
NO_FIELD = "no_040"
DEPTH_BUCKETS = (NO_FIELD, *DEPTH_FLOORS)
CHANNELS = ("oclc", "rlin", "alma_cz", "local_system", "pod_system", "any_system")
# Namespaces that show a channel, as LIKE patterns, and how their owner may stand to the holder.
CHANNEL_NAMESPACES = {
    "oclc": ("OCOLC%",),
    "rlin": ("CSTRLIN",),
    "alma_cz": ("EXLCZ", "CKB"),
    "local_system": ("SIRSI", "PUVOYAGERBIBID"),
    "any_system": ("_%",),
}
CHANNEL_OWNERS = {"local_system": "=", "pod_system": "<>"}

# Field coverage measures: what makes a row count for each, call numbers apart.
COVERAGE_FIELDS = {
    "isbn": "tag = '020'",
    "subjects": "startswith(tag, '6')",
    "author": "tag IN ('100', '110', '111')",
    "online": "tag = '856'",
    "phys_desc": "tag = '300'",
}
COVERAGE_TAGS = ("020", "100", "110", "111", "856", "300")
