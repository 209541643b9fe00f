"""Run Spark SQL text against DataFrames by name, without claiming names in the session."""

import re
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


class Views:
    """
    Temporary views of unique names over DataFrames, dropped together.

    Dropping a view makes Spark drop what is cached for its frame and rebuild what is
    still loading from it, so views stand for as long as results built on them are held.
    """

    def __init__(self):
        self._names: dict[DataFrame, str] = {}
        self._lock = Lock()

    def __len__(self) -> int:
        return len(self._names)

    def name(self, df: DataFrame) -> str:
        with self._lock:
            if df not in self._names:
                name = f"bound_{uuid4().hex}"
                df.createOrReplaceTempView(name)
                self._names[df] = name
            return self._names[df]

    def drop(self) -> None:
        while self._names:
            df, name = self._names.popitem()
            df.sparkSession.catalog.dropTempView(name)


def bind(
    spark: SparkSession,
    text: str,
    views: Views | None = None,
    standing: dict[str, DataFrame] | None = None,
    passing: dict[str, DataFrame] | None = None,
    /,
    **tables: DataFrame,
) -> DataFrame:
    """
    Run ``text`` with each table name after FROM or JOIN standing for the DataFrame.

    The text stays runnable as it is wherever tables of those names exist; here they are
    replaced by views of unique names, so concurrent lakes never meet. Views of
    ``standing`` frames stay in ``views``; all others go once the text is analysed. Table
    names are rewritten outside string literals and comments, with or without an alias;
    tables in a comma list are not found.
    """
    brief = Views()
    named = [(name, df, views) for name, df in (standing or {}).items()]
    named += [(name, df, brief) for name, df in ((passing or {}) | tables).items()]
    parts = _QUOTED.split(text)
    try:
        for name, df, holder in named:
            reference = re.compile(
                rf"\b(FROM|JOIN)(\s+){name}\b(?!\s*\.)(?=(\s+AS\b|\s+(?!{_AFTER}\b)[A-Za-z_]\w*)?)", re.IGNORECASE
            )

            def view(m: re.Match, df=df, holder=holder, name=name) -> str:
                return f"{m[1]}{m[2]}{holder.name(df)}" + ("" if m[3] else f" AS {name}")

            parts[::2] = [reference.sub(view, part) for part in parts[::2]]
        return spark.sql("".join(parts))
    finally:
        brief.drop()


# String literals, quoted names and comments: nothing inside them is a table.
_QUOTED = re.compile(r"""((?:\br)?'(?:[^'\\]|\\.)*'|`[^`]*`|"[^"]*"|--[^\n]*)""")
# What may follow a table name without being its alias.
_AFTER = (
    "(?:WHERE|GROUP|ORDER|HAVING|LIMIT|JOIN|LEFT|RIGHT|FULL|INNER|CROSS|SEMI|ANTI|NATURAL|ON|USING|UNION|EXCEPT"
    "|INTERSECT|LATERAL|WINDOW|PIVOT|SORT|CLUSTER|DISTRIBUTE|TABLESAMPLE|QUALIFY)"
)
