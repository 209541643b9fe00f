import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelftally import Lake, Params, schema
from shelftally.sources.code_map import code_map_from_rows

BOOK = "00000nam a2200000 a 4500"
SERIAL = "00000nas a2200000 a 4500"

# (org, code, is MARC) claims used by the provenance and channel tests.
CLAIMS = [
    ("brown", "RBN", False),
    ("duke", "NcD", True),
    ("duke", "NDD", False),
    ("harvard", "MH", True),
    ("harvard", "HVL", False),
    ("harvard", "HMS", False),
    ("penn", "PU", True),
    ("princeton", "NjP", True),
    ("princeton", "PUL", False),
    ("stanford", "CSt", True),
    ("stanford", "STF", False),
]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    yield session
    session.stop()


def f008(entered="000000", kind="s", date1="2014", date2="    ", place="cau", lang="eng"):
    """A 40-character 008 field."""
    return f"{entered}{kind}{date1}{date2}{place:3}{'':17}{lang:3}  "


class Shelf:
    """Collects records field by field and makes a lake of them."""

    def __init__(self, spark):
        self.spark = spark
        self.rows = []
        self.meta = []

    def add(self, org, rid, *fields, leader=BOOK, title=None, count=True):
        """
        ``fields`` are ``(tag, value)`` for control fields, or ``(tag, code, value)`` with
        optional first and second indicator. A list of the latter is one field.
        """
        key = f"{org}:{rid}"
        self.rows.append((org, key, "LDR", 0, None, None, None, None, leader))
        for seq, field in enumerate(fields, 1):
            if isinstance(field, tuple) and len(field) == 2:
                self.rows.append((org, key, field[0], seq, None, None, None, None, field[1]))
                continue
            for sub, part in enumerate(field if isinstance(field, list) else [field]):
                tag, code, value, *ind = part
                ind1, ind2 = (*ind, " ", " ")[:2]
                self.rows.append((org, key, tag, seq, ind1, ind2, code, sub, value))
        if count:
            self.meta.append((org, key, rid if title is None else title))
        return self

    def lake(self, claims=CLAIMS, harvest=None, **params):
        return Lake(
            self.spark,
            self.spark.createDataFrame(self.rows, schema.RECORDS),
            self.spark.createDataFrame(self.meta, schema.RECORD_META),
            code_map_from_rows(self.spark, claims) if claims else None,
            None if harvest is None else self.spark.createDataFrame(harvest, schema.HARVEST_STATE),
            Params(**params),
        )


@pytest.fixture
def shelf(spark):
    return Shelf(spark)


@pytest.fixture
def two_orgs(shelf):
    """Stanford holds a shared and an own title, Harvard the shared one."""
    shelf.add("stanford", "a1", ("008", f008()), ("245", "a", "Title a1", "1", "0"), ("650", "a", "Music", " ", "0"), title="shared")
    shelf.add("stanford", "a2", ("008", f008(lang="fre")), ("245", "a", "Title a2", "1", "0"), title="own")
    shelf.add("harvard", "b1", ("008", f008()), ("245", "a", "Title b1", "1", "0"), title="shared")
    return shelf


def as_set(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def cells(df, org):
    return {r["category"]: r["n"] for r in df.collect() if r["org"] == org}
