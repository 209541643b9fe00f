"""Display names for coded values. A code without a name shows as itself."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelftally.functions import exprs as x

# Code -> name, codes in lower case.
RECORD_TYPE = {
    "a": "Language material",
    "c": "Notated music",
    "d": "Manuscript music",
    "e": "Cartographic",
    "f": "Manuscript cartographic",
    "g": "Projected medium",
    "i": "Nonmusical sound",
    "j": "Musical sound",
    "k": "Two-dimensional image",
    "m": "Computer file",
    "o": "Kit",
    "p": "Mixed material",
    "r": "Three-dimensional object",
    "t": "Manuscript language material",
}

LANGUAGE = {
    "eng": "English",
    "fre": "French",
    "ger": "German",
    "spa": "Spanish",
    "ita": "Italian",
    "rus": "Russian",
    "por": "Portuguese",
    "chi": "Chinese",
    "ara": "Arabic",
    "lat": "Latin",
    "jpn": "Japanese",
    "heb": "Hebrew",
    "dut": "Dutch",
    "pol": "Polish",
    "gre": "Greek, Modern",
    "grc": "Greek, Ancient",
    "kor": "Korean",
    "tur": "Turkish",
    "per": "Persian",
    "hin": "Hindi",
    "san": "Sanskrit",
    "swe": "Swedish",
    "dan": "Danish",
    "nor": "Norwegian",
    "fin": "Finnish",
    "cze": "Czech",
    "hun": "Hungarian",
    "rum": "Romanian",
    "ukr": "Ukrainian",
    "cat": "Catalan",
    "yid": "Yiddish",
    "vie": "Vietnamese",
    "tha": "Thai",
    "ind": "Indonesian",
    "wel": "Welsh",
    "gle": "Irish",
    "scr": "Croatian",
    "srp": "Serbian",
    "bul": "Bulgarian",
    "slo": "Slovak",
    "slv": "Slovenian",
    "zxx": "No linguistic content",
    "mul": "Multiple languages",
    "und": "Undetermined",
}

PLACE = {
    "xxu": "United States",
    "alu": "Alabama",
    "aku": "Alaska",
    "azu": "Arizona",
    "aru": "Arkansas",
    "cau": "California",
    "cou": "Colorado",
    "ctu": "Connecticut",
    "dcu": "Washington, D.C.",
    "deu": "Delaware",
    "flu": "Florida",
    "gau": "Georgia",
    "hiu": "Hawaii",
    "idu": "Idaho",
    "ilu": "Illinois",
    "inu": "Indiana",
    "iau": "Iowa",
    "ksu": "Kansas",
    "kyu": "Kentucky",
    "lau": "Louisiana",
    "meu": "Maine",
    "mdu": "Maryland",
    "mau": "Massachusetts",
    "miu": "Michigan",
    "mnu": "Minnesota",
    "msu": "Mississippi",
    "mou": "Missouri",
    "mtu": "Montana",
    "nbu": "Nebraska",
    "nvu": "Nevada",
    "nhu": "New Hampshire",
    "nju": "New Jersey",
    "nmu": "New Mexico",
    "nyu": "New York",
    "ncu": "North Carolina",
    "ndu": "North Dakota",
    "ohu": "Ohio",
    "oku": "Oklahoma",
    "oru": "Oregon",
    "pau": "Pennsylvania",
    "riu": "Rhode Island",
    "scu": "South Carolina",
    "sdu": "South Dakota",
    "tnu": "Tennessee",
    "txu": "Texas",
    "utu": "Utah",
    "vtu": "Vermont",
    "vau": "Virginia",
    "wau": "Washington",
    "wvu": "West Virginia",
    "wiu": "Wisconsin",
    "wyu": "Wyoming",
    "xxc": "Canada",
    "abc": "Alberta",
    "bcc": "British Columbia",
    "mbc": "Manitoba",
    "onc": "Ontario",
    "quc": "Québec",
    "xxk": "United Kingdom",
    "enk": "England",
    "stk": "Scotland",
    "wlk": "Wales",
    "nik": "Northern Ireland",
    "ie": "Ireland",
    "fr": "France",
    "gw": "Germany",
    "it": "Italy",
    "sp": "Spain",
    "ne": "Netherlands",
    "be": "Belgium",
    "sw": "Sweden",
    "sz": "Switzerland",
    "dk": "Denmark",
    "no": "Norway",
    "fi": "Finland",
    "po": "Portugal",
    "gr": "Greece",
    "au": "Austria",
    "hu": "Hungary",
    "pl": "Poland",
    "rm": "Romania",
    "bu": "Bulgaria",
    "ru": "Russia (Federation)",
    "ur": "Soviet Union",
    "un": "Ukraine",
    "ic": "Iceland",
    "cc": "China",
    "ja": "Japan",
    "ko": "Korea, South",
    "ii": "India",
    "is": "Israel",
    "ir": "Iran",
    "tu": "Turkey",
    "mx": "Mexico",
    "bl": "Brazil",
    "ag": "Argentina",
    "cl": "Chile",
    "pe": "Peru",
    "ck": "Colombia",
    "at": "Australia",
    "nz": "New Zealand",
    "sa": "South Africa",
    "vp": "Various places",
    "xx": "Unknown",
}

LC_CLASS = {
    "a": "General Works",
    "b": "Philosophy & Religion",
    "c": "Auxiliary Sciences of History",
    "d": "World History",
    "e": "American History",
    "f": "American & Local History",
    "g": "Geography & Anthropology",
    "h": "Social Sciences",
    "j": "Political Science",
    "k": "Law",
    "l": "Education",
    "m": "Music",
    "n": "Fine Arts",
    "p": "Language & Literature",
    "q": "Science",
    "r": "Medicine",
    "s": "Agriculture",
    "t": "Technology",
    "u": "Military Science",
    "v": "Naval Science",
    "z": "Library Science",
}

SERIAL_STATUS = {"c": "Still published", "d": "Ceased", "u": "Status unknown"}

SUCCESSION_LINK = {
    "pred": "Continues an earlier title (780)",
    "succ": "Continued by a later title (785)",
}

SUCCESSION_TYPE = {
    "0": "Continued by",
    "1": "Continued in part by",
    "2": "Superseded by",
    "3": "Superseded in part by",
    "4": "Absorbed by",
    "5": "Absorbed in part by",
    "6": "Split into",
    "7": "Merged to form",
    "8": "Changed back to",
}

SOURCE_BUCKET = {
    "lc": "Library of Congress",
    "self": "This institution",
    "pod": "Another member",
    "other": "Some other agency",
    "none": "No agency given",
}

MOD_DEPTH = {"no_040": "No 040 field", "0": "None"}

DESTINATION = {
    "finding_aid": "Finding-aid platform",
    "aggregator": "Aggregator (OAC, ArchiveGrid)",
    "resolver": "Persistent-ID resolver",
    "repository": "Digital repository",
    "vendor": "Vendor / licensed",
    "other": "Other",
}

COVERAGE_FIELD = {
    "isbn": "ISBN (020)",
    "subjects": "Subjects (6xx)",
    "author": "Author (1xx)",
    "online": "Online access (856)",
    "phys_desc": "Physical description (300)",
    "lc_classification": "LC classification",
}

CHANNEL = {
    "any_system": "Any system number",
    "oclc": "OCLC / WorldCat",
    "rlin": "RLIN (RLG, pre-2006)",
    "alma_cz": "Ex Libris Community Zone",
    "local_system": "A local library system",
    "pod_system": "Another member's system",
}

AGENCY = {
    "dlc": "Library of Congress",
    "dlc-r": "Library of Congress (retrospective)",
    "ocolc": "OCLC",
    "gpo": "U.S. Government Publishing Office",
    "dgpo": "U.S. Government Publishing Office",
    "agl": "National Agricultural Library",
    "dnlm": "National Library of Medicine",
    "nlm": "National Library of Medicine",
    "ukm": "British Library",
    "ukmgb": "British Library",
    "caoonl": "Library and Archives Canada",
    "rpb": "Brown",
    "rbn": "Brown",
    "rpjcb": "Brown (John Carter Brown Library)",
    "ncd": "Duke",
    "ndd": "Duke",
    "mh": "Harvard",
    "mh-l": "Harvard (Law School)",
    "mh-hy": "Harvard (Yenching)",
    "mh-mu": "Harvard (Music)",
    "mh-fa": "Harvard (Fine Arts)",
    "hls": "Harvard (Law School)",
    "hul": "Harvard (University Library)",
    "hms": "Harvard (Medical School)",
    "hbs": "Harvard (Business School)",
    "ddo": "Harvard (Dumbarton Oaks)",
    "pu": "Penn",
    "pau": "Penn",
    "njp": "Princeton",
    "njp-g": "Princeton (Firestone)",
    "pul": "Princeton",
    "pulea": "Princeton (East Asian)",
    "cst": "Stanford",
    "cst-h": "Stanford (Hoover Institution)",
    "cst-law": "Stanford (Law)",
    "stf": "Stanford",
    "miaapq": "ProQuest",
    "umi": "ProQuest (UMI)",
    "eblcp": "ProQuest Ebook Central",
    "lexisnexis": "LexisNexis",
    "vaalasp": "Alexander Street Press",
    "ukmbam-d": "Adam Matthew Digital",
    "migcl": "Gale",
    "naxos": "Naxos",
    "itfic": "Casalini Libri",
    "ydx": "YBP Library Services",
    "btcta": "Baker & Taylor",
    "n$t": "EBSCO",
    "gw5xe": "Springer",
    "e7b": "ebrary",
    "mwa": "American Antiquarian Society",
}

NAMESPACE = {
    "ocolc": "OCLC / WorldCat",
    "ocolc-m": "OCLC master record",
    "ocolc-i": "OCLC institution record",
    "ocolc-p": "OCLC provisional record",
    "cstrlin": "RLIN (RLG union catalogue)",
    "exlcz": "Ex Libris Community Zone",
    "ckb": "Ex Libris knowledge base",
    "sirsi": "Sirsi/Symphony (local)",
    "puvoyagerbibid": "Voyager (local)",
    "pqkb": "ProQuest knowledge base",
    "ssid": "ProQuest (SSID)",
    "miaaatc": "ProQuest (Ann Arbor)",
    "ecco": "Gale ECCO",
    "dash": "Harvard DASH repository",
    "cotsendb": "Cotsen Children's Library",
    "idcotsen": "Cotsen Children's Library",
    "hsp": "Historical Society of Pennsylvania",
    "caotulas": "University of Toronto",
    "hkul": "University of Hong Kong",
    "muls": "Minnesota Union List of Serials",
    "isjeaiw": "Index to Jewish Periodicals",
}

# Orgs whose display name is not their code with an initial capital.
ORG = {"jhu": "JHU", "mit": "MIT"}


def _named(df: DataFrame, column: str, table: dict[str, str], name: str) -> DataFrame:
    """Join a fixed table of names on the code in lower case."""
    rows = ", ".join(f"({x.literal(k)}, {x.literal(v)})" for k, v in table.items())
    names = df.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS names(_key, {name})")
    # the tables above are closed lists of at most about a hundred rows
    return df.join(F.broadcast(names), F.lower(F.col(column)) == F.col("_key"), "left").drop("_key")


def label(df: DataFrame, column: str, table: dict[str, str], into: str = "label") -> DataFrame:
    """Add the display name of a code; a code the table lacks names itself."""
    return _named(df, column, table, "_name").withColumn(
        into, F.coalesce("_name", column)
    ).drop("_name")


def _with_code(column: str) -> F.Column:
    return F.coalesce(F.concat("_name", F.lit(" ("), column, F.lit(")")), column)


def label_agency(df: DataFrame, column: str = "category", into: str = "label") -> DataFrame:
    """Names of agencies, with the code so that two codes of one agency stay apart."""
    return _named(df, column, AGENCY, "_name").withColumn(into, _with_code(column)).drop("_name")


def label_namespace(df: DataFrame, column: str = "category", into: str = "label") -> DataFrame:
    """Names of namespaces, else of the agency with that code, with the code itself."""
    named = _named(_named(df, column, NAMESPACE, "_own"), column, AGENCY, "_agency")
    named = named.withColumn("_name", F.coalesce("_own", "_agency"))
    return named.withColumn(into, _with_code(column)).drop("_own", "_agency", "_name")


def org_label(column: str = "org") -> F.Column:
    """An org's display name: an override, or its code with the first letter capital."""
    name = F.concat(F.upper(F.substring(column, 1, 1)), F.expr(f"substring({column}, 2)"))
    for code, shown in ORG.items():
        name = F.when(F.col(column) == code, F.lit(shown)).otherwise(name)
    return name
