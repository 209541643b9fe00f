"""
Roll-ups kept by org between runs, and renewed for the orgs that have changed.

Every roll-up of records is a sum within an org, so a changed org's rows are replaced and all
others stand. Titles cross orgs: each org's titles are kept, what a changed org lost and won
is the difference to what it has now, and only the bits of those titles are taken back or set
in the stored masks. The lake is read in the folders of the changed orgs alone.

A store keeps all roll-ups, or those named: a report reads one of them, and a store for it
alone need not pay for the others. Reports on what a store does not keep read the lake.

The table of states is written last, so a refresh that fails is done again by the next one; a
mark says that masks and titles may not belong together, and they are then put together anew.
"""

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelftally.operators import channels, fixed_fields, overlap, provenance
from shelftally.sources.lake import Lake, cut

#: Roll-ups with an ``org`` column whose rows depend on that org's records only.
BY_ORG: dict[str, Callable[[Lake], str]] = {
    "cataloging_counts": lambda lake: provenance.counts_sql(lake.params, lake.by_record),
    "fixed_fields": lambda lake: fixed_fields.FIXED_SQL,
    "namespace_patterns": lambda lake: channels.PATTERNS_SQL,
}
HOLDINGS = "SELECT org, title_key, count(*) AS records FROM record_meta WHERE org IS NOT NULL GROUP BY org, title_key"
#: The titles of each org, and the masks of holders put together from them.
TITLES = "titles"
ROLLUPS = (*BY_ORG, TITLES)
STATE = "org string, last_modified timestamp"


@dataclass(frozen=True)
class Changes:
    """Orgs by what a refresh does with them."""

    fresh: tuple[str, ...] = ()
    gone: tuple[str, ...] = ()
    #: An org came or went, so the bits of the masks have other meanings.
    renumbered: bool = False

    def __bool__(self) -> bool:
        return bool(self.fresh or self.gone)


class RollupStore:
    """Roll-ups under a folder: one table each in folders by org, the masks of titles, and the state they hold."""

    def __init__(self, spark: SparkSession, path: str, rollups: Iterable[str] = ROLLUPS):
        self.spark, self.path = spark, path.rstrip("/")
        self.rollups = frozenset(rollups)
        if self.rollups - set(ROLLUPS):
            raise ValueError("no such roll-ups: " + ", ".join(sorted(self.rollups - set(ROLLUPS))))

    def _tables(self, rollups: Iterable[str]) -> list[str]:
        """The stored tables of some roll-ups."""
        return [name for name in BY_ORG if name in rollups] + (["holdings", "masks"] if TITLES in rollups else [])

    # --- files -------------------------------------------------------------

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        files, path = self._fs(name)
        return files.exists(path)

    def _mark(self, name: str) -> None:
        files, path = self._fs(name)
        files.create(path, True).close()

    def _delete(self, name: str) -> None:
        files, path = self._fs(name)
        files.delete(path, True)

    def _folder(self, name: str, org: str) -> str:
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(org)
        return f"{name}/org={escaped}"

    def _replace(self, name: str, orgs: tuple[str, ...], df: DataFrame | None) -> None:
        """Put ``df`` in place of the folders of some orgs."""
        for org in orgs:
            self._delete(self._folder(name, org))
        if df is not None:
            df.write.mode("append").partitionBy("org").parquet(f"{self.path}/{name}")

    def _swap(self, df: DataFrame, name: str) -> None:
        """Write a table beside the one it is made from, then put it in its place."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}.next")
        self._delete(name)
        files, path = self._fs(f"{name}.next")
        files.rename(path, self._fs(name)[1])

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}")
        if name != "state" and dict(df.dtypes).get("org", "string") != "string":
            # a folder name is an org's name, whatever it looks like
            fields = [T.StructField("org", T.StringType()) if f.name == "org" else f for f in df.schema.fields]
            df = self.spark.read.schema(T.StructType(fields)).parquet(f"{self.path}/{name}")
        return df

    # --- what has changed ----------------------------------------------------

    def state(self) -> DataFrame:
        return self.read("state") if self._exists("state") else self.spark.createDataFrame([], STATE)

    def _complete(self) -> bool:
        """Whether every table to keep is there, and not left half built by a refresh that was to add some."""
        return not self._exists("growing") and all(self._exists(name) for name in self._tables(self.rollups))

    def changes(self, lake: Lake) -> Changes:
        """
        Orgs whose date of change differs from the stored one; without a date an org counts as
        changed, and so does every org where a roll-up to keep is not there yet.
        """
        if lake.harvest_state is None:
            raise ValueError("a refresh needs the table of sync dates")
        now = lake.roster.select("org").join(lake.harvest_state.groupBy("org").agg(F.max("last_modified").alias("now")), "org", "left")
        both = now.withColumn("here", F.lit(True)).join(self.state().withColumn("stored", F.lit(True)), "org", "full")
        same = F.coalesce(F.col("now") == F.col("last_modified"), F.lit(False)) & F.lit(self._complete())
        rows = both.select("org", "here", "stored", same.alias("same")).collect()
        return Changes(
            tuple(sorted(r["org"] for r in rows if r["here"] and not (r["stored"] and r["same"]))),
            tuple(sorted(r["org"] for r in rows if not r["here"])),
            any(not r["here"] or not r["stored"] for r in rows),
        )

    # --- refresh -------------------------------------------------------------

    def refresh(self, lake: Lake) -> Changes:
        """
        Bring the store up to the lake; what changed is returned. One refresh at a time, and no reader
        meanwhile. Roll-ups that are there but not to be kept would fall behind, and go.
        """
        found = self.changes(lake)
        if not found:
            return found
        torn = self._exists("pending")
        if not self._complete():
            self._mark("growing")
        self._mark("pending")
        both = found.fresh + found.gone
        kept = self.state().where(~F.col("org").isin(list(both)))
        changed = lake.only(found.fresh)
        for name in self._tables(set(ROLLUPS) - self.rollups):
            self._delete(name)
        for name, text in BY_ORG.items():
            if name in self.rollups:
                self._replace(name, both, changed.sql(text(lake)) if found.fresh else None)
        if TITLES in self.rollups:
            self._refresh_titles(lake, changed, found, torn or found.renumbered or not self._exists("masks"))
        dates = lake.harvest_state.groupBy("org").agg(F.max("last_modified").alias("last_modified"))
        fresh = lake.roster.where(F.col("org").isin(list(found.fresh))).select("org").join(dates, "org", "left")
        self._swap(kept.unionByName(fresh).coalesce(1), "state")
        self._delete("growing")
        self._delete("pending")
        changed.release()
        return found

    def _refresh_titles(self, lake: Lake, changed: Lake, found: Changes, whole: bool) -> None:
        """Renew the titles of the changed orgs, and the masks: those of moved titles, or all from the stored titles."""
        words = overlap.masks(lake.org_count)
        both = found.fresh + found.gone
        if whole:
            self._replace("holdings", both, changed.sql(HOLDINGS) if found.fresh else None)
            bits = self.read("holdings").join(lake.roster, "org").withColumns(_bits(words))
            sums = [F.bit_or(w).alias(w) for w in words]
            self._swap(bits.groupBy("title_key").agg(*sums, F.sum("records").alias("records")), "masks")
            return
        moved = cut(self._moved(lake, changed, found.fresh, words))
        self._replace("holdings", found.fresh, changed.sql(HOLDINGS))
        self._swap(_retracted(self.read("masks"), moved, words), "masks")

    def _moved(self, lake: Lake, changed: Lake, orgs: tuple[str, ...], words: list[str]) -> DataFrame:
        """Per title that an org lost, won, or has in another number of records: bits to take back and to set."""
        old = self.read("holdings").where(F.col("org").isin(list(orgs)))
        signed = old.select("org", "title_key", F.lit(-1).alias("sign"), "records").unionByName(
            changed.sql(HOLDINGS).select("org", "title_key", F.lit(1).alias("sign"), "records")
        )
        held = signed.groupBy("org", "title_key").agg(
            F.sum(F.col("sign") * F.col("records")).alias("records"), F.min("sign").alias("had"), F.max("sign").alias("has")
        )
        held = held.where("records <> 0 OR had = has").join(lake.roster, "org").withColumns(_bits(words))
        lost, won = F.col("has") < 0, F.col("had") > 0
        sums = [F.coalesce(F.bit_or(F.when(test, F.col(w))), F.lit(0).cast("long")).alias(f"{name}_{w}") for w in words for name, test in (("lost", lost), ("won", won))]
        return held.groupBy("title_key").agg(*sums, F.sum("records").alias("more"))

    # --- reading -------------------------------------------------------------

    def serve(self, lake: Lake) -> Lake:
        """Let a lake's operators read the stored roll-ups in place of the lake."""
        for name in BY_ORG:
            if name in self.rollups:
                lake.adopt(name, self.read(name))
        if TITLES not in self.rollups:
            return lake
        words = overlap.masks(lake.org_count)
        keyed = F.col("title_key").isNotNull().alias("keyed")
        masks = self.read("masks").groupBy(*words, keyed).agg(F.count("*").alias("titles"), F.sum("records").alias("records"))
        lake.keep("patterns", lambda: masks)
        return lake


def _bits(words: list[str]) -> dict[str, Column]:
    """The bit of each org's position, in the word that has it."""
    place = F.col("position")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % overlap.WORD).cast("int"))
    return {w: F.when(F.floor(place / overlap.WORD) == i, bit).otherwise(F.lit(0).cast("long")) for i, w in enumerate(words)}


def _retracted(masks: DataFrame, moved: DataFrame, words: list[str]) -> DataFrame:
    """
    Masks with the bits of moved titles taken back and set. Only the moved titles are looked
    up, which is a broadcast where they are few; a title without records left goes.
    """
    named = moved.withColumnRenamed("title_key", "_title")
    same = F.col("title_key").eqNullSafe(F.col("_title"))
    none = F.lit(0).cast("long")

    def after(word: str, before: Column) -> Column:
        kept = before.bitwiseAND(F.bitwise_not(F.coalesce(f"lost_{word}", none)))
        return kept.bitwiseOR(F.coalesce(f"won_{word}", none)).alias(word)

    records = (F.coalesce("records", none) + F.coalesce("more", none)).alias("records")
    known = masks.join(named, same, "left").select("title_key", *(after(w, F.col(w)) for w in words), records)
    came = named.join(masks.select("title_key"), same, "left_anti").select(
        F.col("_title").alias("title_key"), *(after(w, none) for w in words), F.col("more").alias("records")
    )
    return known.unionByName(came).where("records > 0")
