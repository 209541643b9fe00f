"""The input tables of one run, and the small roll-ups its operators share."""

import re
import tempfile
from collections.abc import Callable, Mapping
from functools import cached_property
from threading import RLock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from shelftally import schema
from shelftally.params import Params
from shelftally.sources.binding import Views, bind


def shared_folder(spark: SparkSession) -> str | None:
    """This application's part of the folder every executor can reach, if one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}" if root else None


def cut(df: DataFrame) -> DataFrame:
    """
    The same rows from a checkpoint, with a plan that no longer holds what made them: for
    loops, and for small results of long plans. The folder is the cluster's shared one; a
    local one only where none is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession) or tempfile.mkdtemp())
    return df.checkpoint()


# In a query: rows are dealt by a hash of the record, which a lake bucketed by record makes needless.
DEAL = "/*+ REPARTITION(h) */ "
#: Records whose rows one task sorts and groups in memory; larger lakes are dealt over more tasks.
DEALT_RECORDS = 50_000

# Whether a query reads the records themselves, and not only what is made of them.
_READS_RECORDS = re.compile(r"\b(FROM|JOIN)\s+records\b", re.IGNORECASE)

# One row per org, so the single ordered partition of the numbering stays small.
ROSTER_SQL = """\
SELECT org, row_number() OVER (ORDER BY org) - 1 AS position
FROM (SELECT DISTINCT org FROM record_meta WHERE org IS NOT NULL)"""


class Lake:
    """
    ``records`` (one row per subfield) and ``record_meta`` (one row per record), with
    an optional code map and an optional table of sync dates.
    """

    def __init__(
        self,
        spark: SparkSession,
        records: DataFrame | Callable[[], DataFrame],
        record_meta: DataFrame,
        code_map: DataFrame | None = None,
        harvest_state: DataFrame | None = None,
        params: Params | None = None,
        *,
        by_record: bool = False,
    ):
        self.spark = spark
        #: The rows of a record lie in one bucket of the tables, and need not be dealt by record.
        self.by_record = by_record
        #: Names of tables that stand for the lake's files, dropped on release.
        self.declared: list[str] = []
        self.params = params or Params()
        # given as a function, the records are made when they are first read
        self._make_records = records if callable(records) else None
        self._records = None if callable(records) else schema.conform(records, schema.RECORDS, "records")
        self.record_meta = schema.conform(record_meta, schema.RECORD_META, "record_meta")
        self.code_map = (
            None if code_map is None else schema.conform(code_map, schema.CODE_MAP, "code_map")
        )
        self.harvest_state = (
            None
            if harvest_state is None
            else schema.conform(harvest_state, schema.HARVEST_STATE, "harvest_state")
        )
        self._kept: dict[str, DataFrame] = {}
        self._views = Views()
        # one builder of a name at a time, so that reports run side by side share what they keep
        self._locks: dict[str, RLock] = {}
        self._naming = RLock()
        # folders this lake wrote, deleted on release
        self._written: list[str] = []
        # statements that make this lake's tables available under the declared names
        self._steps: list[tuple[str, str]] = []
        self._facts: dict[str, object] = {}
        # guards that have passed for this lake
        self.checked: set[str] = set()

    @classmethod
    def read(
        cls,
        spark: SparkSession,
        records_path: str,
        record_meta_path: str,
        *,
        code_map: DataFrame | None = None,
        harvest_state_path: str | None = None,
        rename: Mapping[str, str] | None = None,
        params: Params | None = None,
        write_records: Callable[[], None] | None = None,
    ) -> "Lake":
        """
        Read a Parquet lake from any path Spark can open. ``rename`` maps the lake's
        own column names onto the declared ones. Nothing is ever written back. A column
        that the files lack is an error, never a column of NULLs. Where ``write_records`` is
        given, it writes the files of ``records`` when they are first read.
        """

        steps = []

        def load(path: str, declared: T.StructType, table: str) -> DataFrame:
            own = {new: old for old, new in (rename or {}).items()}
            df = spark.read.parquet(path)
            names = {f.name: own.get(f.name, f.name) for f in declared.fields}
            missing = {wanted: name for wanted, name in names.items() if name not in df.columns}
            if missing:
                raise schema.SchemaError(
                    f"{path} has no column {', '.join(missing.values())}; its columns are"
                    f" {', '.join(df.columns)}. Map its own names with rename="
                    + "{" + ", ".join(f"'<its name>': '{wanted}'" for wanted in missing) + "}"
                )
            columns = ", ".join(f"`{name}` AS {wanted}" for wanted, name in names.items())
            text = f"CREATE OR REPLACE TEMP VIEW {table} AS\nSELECT {columns}\nFROM parquet.`{path}`"
            steps.append((f"The lake's {table} under the names used here", text))
            return df.select(*[F.col(f"`{name}`").alias(wanted) for wanted, name in names.items()])

        def late_records() -> DataFrame:
            write_records()
            df = load(records_path, schema.RECORDS, "records")
            steps.insert(0, steps.pop())
            lake._steps = steps
            return df

        lake = cls(
            spark,
            late_records if write_records else load(records_path, schema.RECORDS, "records"),
            load(record_meta_path, schema.RECORD_META, "record_meta"),
            code_map,
            load(harvest_state_path, schema.HARVEST_STATE, "harvest_state") if harvest_state_path else None,
            params,
        )
        lake._steps = steps
        return lake

    def steps(self, of: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
        """
        What published queries need first: none where the tables were given as DataFrames. Of
        some statements, the records' own only if one of them reads records.
        """
        if of is not None and not any(_READS_RECORDS.search(text) for _, text in of):
            return [(title, text) for title, text in self._steps if " VIEW records AS" not in text]
        if self._steps:
            self.records  # noqa: B018 the statements name its files
        return list(self._steps)

    @property
    def records(self) -> DataFrame:
        """One row per subfield."""
        with self._lock("records"):
            if self._records is None:
                self._records = schema.conform(self._make_records(), schema.RECORDS, "records")
            return self._records

    # --- running text ------------------------------------------------------

    def sql(self, text: str, **extra: DataFrame) -> DataFrame:
        """Run Spark SQL over ``records``, ``record_meta``, ``code_map`` and ``extra``."""
        if DEAL in text:
            text = text.replace(DEAL, "" if self.by_record else self._deal())
        tables = {"record_meta": self.record_meta}
        if "records" not in extra and _READS_RECORDS.search(text):
            tables["records"] = self.records
        if self.code_map is not None:
            tables["code_map"] = self.code_map
        kept = {id(df) for df in [*self._kept.values(), *tables.values()]}
        standing = {name: df for name, df in (tables | extra).items() if id(df) in kept}
        passing = {name: df for name, df in (tables | extra).items() if id(df) not in kept}
        return bind(self.spark, text, self._views, standing, passing)

    def _deal(self) -> str:
        """Spark deals a small lake by itself; of a large one each task gets so many records, however large it is."""
        tasks = -(-self.record_count // DEALT_RECORDS)
        return DEAL if tasks <= self.spark.sparkContext.defaultParallelism else f"/*+ REPARTITION({tasks}, h) */ "

    @property
    def record_count(self) -> int:
        """Records of the lake, which sizes what is dealt by record."""
        return self.fact("record_count", self.record_meta.count)

    # --- shared roll-ups ---------------------------------------------------

    def _lock(self, name: str) -> RLock:
        with self._naming:
            return self._locks.setdefault(name, RLock())

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """
        Build a roll-up once and hold it for every operator that reads it. It is cut off from
        what made it, so that the plans of its readers stay as small as it is.
        """
        with self._lock(name):
            if name not in self._kept:
                self._kept[name] = cut(build()).persist(StorageLevel.MEMORY_AND_DISK)
            return self._kept[name]

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """
        ``keep`` for the roll-ups that cost a pass over the lake. Where the cluster names
        a shared folder in ``spark.checkpoint.dir`` they are written there and read back,
        so that a lost executor does not cost the pass again; else they are held in memory.
        """
        folder = shared_folder(self.spark)
        if folder is None:
            return self.keep(name, build)
        with self._lock(name):
            if name not in self._kept:
                path = f"{folder}/{name}-{uuid4().hex}"
                self.own(path)
                build().write.parquet(path)
                self._kept[name] = self.spark.read.parquet(path)
            return self._kept[name]

    def counts(self, name: str, text: str, **extra: DataFrame) -> DataFrame:
        """
        The small ``(org, category, n)`` result of a query, held because a matrix reads it
        for its axis, its denominators and its cells while the lake is scanned once.
        """
        return self.keep(f"counts of {name}", lambda: self.sql(text, **extra))

    def measured(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """
        ``keep``, computed now, so that Spark knows the true size when it plans a join
        with it: broadcast under ``spark.sql.autoBroadcastJoinThreshold``, and a
        shuffled join with adaptive skew handling above it.
        """
        with self._lock(name):
            fresh = name not in self._kept
            df = self.keep(name, build)
            if fresh:
                df.count()
            return df

    def fact(self, name: str, build: Callable[[], object]):
        """Something small that is worked out once for this lake, such as a published axis."""
        with self._lock(name):
            if name not in self._facts:
                self._facts[name] = build()
            return self._facts[name]

    def adopt(self, name: str, df: DataFrame) -> None:
        """Take a roll-up that was built elsewhere in place of building it."""
        with self._lock(name):
            self._kept[name] = df

    def only(self, orgs) -> "Lake":
        """The lake of some orgs: a filter that reaches folders by org."""
        mine = F.col("org").isin(list(orgs))
        return Lake(
            self.spark,
            lambda: self.records.where(mine),
            self.record_meta.where(mine),
            self.code_map,
            self.harvest_state,
            self.params,
            by_record=self.by_record,
        )

    def own(self, folder: str) -> None:
        """Delete a folder when the lake is released."""
        self._written.append(folder)

    def release(self) -> None:
        """Drop every roll-up this lake holds, and delete what it wrote for them."""
        for df in list(self._kept.values()):
            df.unpersist()
        self._kept.clear()
        self._facts.clear()
        self._views.drop()
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        while self._written:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._written.pop())
            path.getFileSystem(hadoop).delete(path, True)
        while self.declared:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.declared.pop()}")
        self.checked.clear()
        self.__dict__.pop("org_count", None)

    @property
    def roster(self) -> DataFrame:
        """Every org in the lake with a dense position from 0, in name order."""
        return self.measured("roster", lambda: self.sql(ROSTER_SQL))

    @cached_property
    def org_count(self) -> int:
        return self.roster.count()
