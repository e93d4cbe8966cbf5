"""Runs that were stored in a SQLite file: their tables, and what they mean here.

``SqliteTable`` (format ``sqlite_table``) reads one table by ranges of its row
numbers, a task each. With ``pushdown`` SQLite runs the filters that compare a
column with values: the ranges shrink to the rows that can pass, and only those
leave it. Spark keeps the filters of such a source with the loaded table, so a
table that is read with pushdown must not be filtered in two ways in one query;
``stored_results`` loads one for each set. The file must be on a disk that all
executors see.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith

ROWS = 1_000_000
BATCH = 10_000
# The columns of the stored tables that are read.
TABLES = {
    "pair": "r1 string, r2 string, identifier string",
    "unique_pair": "pair_id long, multiplicity long",
    "target": "name string, seq string",
    "result": "set_id long, pair_id long, target long, mask string, site long, end long, muts long, multiplicity long, failure string, tag_mask long",
    "result_set": "set_id string",
    "tag": "name string",
    "result_tag": "set_id long, result_id long, tag_id long",
    "tag_count": "set_id long, tag_id long, count long",
    "counter": "run_key string, dict_index long, count_key string, count long",
}


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: In a list of more values than this SQLite has no parameters.
MOST_VALUES = 500


def as_sql(f: Filter, columns: dict[str, str]) -> tuple[str, list] | None:
    """SQL and parameters of a filter on columns (SQLite's name by ours), if SQLite means the same by it."""
    if isinstance(f, Not):
        inner = as_sql(f.child, columns)
        return inner and (f"NOT ({inner[0]})", inner[1])
    name = columns.get(f.attribute[0]) if len(f.attribute) == 1 else None
    if name is None:
        return None
    if type(f) in COMPARED and isinstance(f.value, int | str) and not isinstance(f.value, bool):
        return f"{name} {COMPARED[type(f)]} ?", [f.value]
    if isinstance(f, In) and len(f.value) <= MOST_VALUES and all(isinstance(v, int | str) for v in f.value):
        return f"{name} IN ({', '.join('?' * len(f.value))})", [*f.value]
    if isinstance(f, IsNull | IsNotNull):
        return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
    # instr and substr compare as Spark does; LIKE would not care for case
    if isinstance(f, StringContains):
        return f"instr({name}, ?) > 0", [f.value]
    if isinstance(f, StringStartsWith):
        return f"substr({name}, 1, ?) = ?", [len(f.value), f.value]
    if isinstance(f, StringEndsWith) and f.value:
        return f"substr({name}, -?) = ?", [len(f.value), f.value]
    return None


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", ROWS))
        self.where, self.values = "1", []

    def take_filters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what SQLite can run; yields the rest to Spark."""
        names = ["row_id", *(c.rsplit(" ", 1)[0] for c in TABLES[self.table].split(", "))]
        columns = {n: "rowid" if n == "row_id" else f'"{n}"' for n in names}
        for f in filters:
            made = as_sql(f, columns)
            if made is None:
                yield f
            else:
                self.where, self.values = f"{self.where} AND {made[0]}", [*self.values, *made[1]]

    def partitions(self) -> list[RowRange]:
        with opened(self.path) as db:
            there = db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (self.table,)).fetchone()
            first, last = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}" WHERE {self.where}', self.values).fetchone() if there else (None, None)
        return [] if first is None else [RowRange(k, k + self.rows - 1) for k in range(first, last + 1, self.rows)]

    def read(self, part: RowRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partitions
            return
        columns = [c.rsplit(" ", 1) for c in TABLES[self.table].split(", ")]
        types = [pa.int64(), *(pa.string() if t == "string" else pa.int64() for _, t in columns)]
        names = ", ".join(f'"{n}"' for n, _ in columns)
        with opened(self.path) as db:
            rows = db.execute(f'SELECT rowid, {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ? AND {self.where}', (part.first, part.last, *self.values))
            while some := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=["row_id", *(n for n, _ in columns)])


class FilteringReader(SqliteReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.take_filters(filters)


class SqliteTable(DataSource):
    """Options: path, table (of TABLES), rows (row numbers a task), pushdown. A table that the file lacks has no rows."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return "row_id long, " + TABLES[self.options["table"]].replace("end long", "`end` long")

    def reader(self, schema) -> SqliteReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else SqliteReader)(dict(self.options))


def read_table(spark: SparkSession, path: str, table: str, rows: int = ROWS, pushdown: bool = False) -> DataFrame:
    """row_id and the columns of one stored table; pushdown: filters go to SQLite (see above)."""
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses a reader that takes filters
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").options(path=path, table=table, rows=str(rows), pushdown=str(pushdown).lower()).load()


def stored_targets(spark: SparkSession, path: str) -> DataFrame:
    """target_id, name, seq, n."""
    return read_table(spark, path, "target").select(F.col("row_id").cast("int").alias("target_id"), "name", "seq", F.length("seq").alias("n"))


def stored_pairs(spark: SparkSession, path: str, unique: bool = False) -> DataFrame:
    """pair_id, identifier, r1, r2, multiplicity; unique: one pair of each kind, with the number of its copies."""
    rows = read_table(spark, path, "pair").select(F.col("row_id").alias("pair_id"), "identifier", "r1", "r2")
    return rows.join(read_table(spark, path, "unique_pair").select("pair_id", "multiplicity"), "pair_id") if unique else rows.withColumn("multiplicity", F.lit(1).cast("long"))


def stored_results(spark: SparkSession, path: str, set_name: str | None = None) -> DataFrame:
    """One or all result sets in the flat form of ``operators.results``: set_name, pair_id, target_id, mask, site, end, muts, multiplicity, failure, tags.

    Of one set SQLite gives out its rows and its tags alone.
    """
    sets = read_table(spark, path, "result_set").select(F.col("row_id").alias("set_id"), F.col("set_id").alias("set_name"))
    some = {}
    if set_name is not None:
        sets = sets.where(F.col("set_name") == set_name)
        some = {"pushdown": True}
    number_of = [r["set_id"] for r in sets.collect()] if some else []  # names are few
    own = (lambda df: df.where(F.col("set_id").isin(number_of))) if some else (lambda df: df)
    names = read_table(spark, path, "tag").select(F.col("row_id").alias("tag_id"), F.col("name").alias("tag"))
    tags = own(read_table(spark, path, "result_tag", **some)).join(names, "tag_id").groupBy(F.col("result_id").alias("row_id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    rows = own(read_table(spark, path, "result", **some)).join(sets, "set_id").join(tags, "row_id", "left")
    number = lambda c: F.col(c).cast("int").alias(c)
    return rows.select("set_name", "pair_id", F.when(F.col("target") > 0, F.col("target")).cast("int").alias("target_id"), "mask", number("site"), number("end"), number("muts"), "multiplicity", "failure", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
