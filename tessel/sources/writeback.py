"""Write-back of changed cells to a database, through a Python data source writer with two phases.

Tasks write their share of the changes to a staging table of the database, over connections of their own; no row passes the
driver. When all tasks are done the driver's `commit` runs set-based statements over the staging table in one transaction: all
changes are applied or none. A task that dies, or a run that is stopped, ends in `abort`, and attempts that were given up or ran
twice are told apart by a tag, of which only those that reported back count. What became of each row is a table of the database
too, and comes back as a DataFrame.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessel.tables import saved, shared_dir

#: Rows that one statement of a task sends; parts in which results are read back.
BATCH, PARTS = 500, 16


@dataclass
class Staged(WriterCommitMessage):
    tag: str
    rows: int


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Names:
    """The tables of one run, and the statements over them. A cell is a row (key columns, rowkey, col, new, tag)."""

    def __init__(self, table: str, keys: Sequence[str], run: str) -> None:
        self.table, self.keys, self.run = quoted(table), list(keys), run
        self.stage, self.result = quoted(f"stage_{run}"), quoted(f"result_{run}")
        self.same = " AND ".join(f"s.k{k} = {self.table}.{quoted(c)}" for k, c in enumerate(keys))

    def values(self, key: str) -> list:
        own = json.loads(key)
        return [own[c] for c in self.keys]

    def create(self) -> list[str]:
        """Keys are staged in the types of the table's own, else no index over them serves a comparison with these."""
        cells = ", ".join(f"{quoted(c)} AS k{k}" for k, c in enumerate(self.keys))
        texts = ", ".join(f"CAST('' AS TEXT) AS {c}" for c in ("rowkey", "col", "new", "tag"))
        return [
            f"CREATE TABLE {self.stage} AS SELECT {cells}, {texts}, CAST(0 AS INTEGER) AS part FROM {self.table} WHERE 1 = 0",
            f"CREATE TABLE {self.result} (rowkey TEXT, status TEXT, error TEXT, part INTEGER)",
        ]

    def index(self) -> str:
        return f"CREATE INDEX {quoted(f'by_key_{self.run}')} ON {self.stage} (col, {', '.join(f'k{k}' for k in range(len(self.keys)))})"

    def update(self, column: str) -> str:
        """Sets one column of all rows whose cell of it is staged."""
        return f"UPDATE {self.table} SET {quoted(column)} = (SELECT s.new FROM {self.stage} s WHERE s.col = ? AND {self.same}) WHERE EXISTS (SELECT 1 FROM {self.stage} s WHERE s.col = ? AND {self.same})"

    def results(self) -> str:
        """One result for each row, also where several tasks staged its cells."""
        there = " AND ".join(f"t.{quoted(c)} = s.k{k}" for k, c in enumerate(self.keys))
        return f"INSERT INTO {self.result} SELECT DISTINCT s.rowkey, CASE WHEN EXISTS (SELECT 1 FROM {self.table} t WHERE {there}) THEN 'applied' ELSE 'nomatch' END, '', s.part FROM {self.stage} s"


def _statement(connection, sql: str, values: Sequence = ()) -> None:
    cursor = connection.cursor()
    cursor.execute(sql, tuple(values))
    cursor.close()


class _Writer(DataSourceWriter):
    """Stages cells (key, col, new, part) and applies them all at once."""

    def __init__(self, connect: Callable, names: Names) -> None:
        self.connect, self.names = connect, names

    def write(self, iterator) -> Staged:
        tag, rows, held = uuid.uuid4().hex, 0, []
        connection = self.connect()
        marks = ", ".join("?" * (len(self.names.keys) + 5))

        def send() -> None:
            cursor = connection.cursor()
            cursor.executemany(f"INSERT INTO {self.names.stage} VALUES ({marks})", held)
            connection.commit()
            held.clear()

        try:
            for row in iterator:
                held.append((*self.names.values(row["key"]), row["key"], row["col"], row["new"], tag, row["part"]))
                rows += 1
                if len(held) == BATCH:
                    send()
            if held:
                send()
        finally:
            connection.close()
        return Staged(tag, rows)

    def commit(self, messages: list) -> None:
        """One transaction of a few statements, whatever the number of rows: cells of attempts that do not count go, each column is
        set, and the rows' results are written beside it."""
        connection = self.connect()
        try:
            tags = [m.tag for m in messages if m is not None]
            _statement(connection, f"CREATE TABLE {quoted(f'tags_{self.names.run}')} (tag TEXT)")
            connection.cursor().executemany(f"INSERT INTO {quoted(f'tags_{self.names.run}')} VALUES (?)", [(t,) for t in tags])
            _statement(connection, f"DELETE FROM {self.names.stage} WHERE tag NOT IN (SELECT tag FROM {quoted(f'tags_{self.names.run}')})")
            _statement(connection, self.names.index())
            _statement(connection, self.names.results())
            cursor = connection.cursor()
            cursor.execute(f"SELECT DISTINCT col FROM {self.names.stage}")
            for column in sorted((c for (c,) in cursor.fetchall()), key=lambda c: (c in self.names.keys, c)):  # keys last: rows are found by them
                _statement(connection, self.names.update(column), (column, column))
            _statement(connection, f"DROP TABLE {self.names.stage}")
            _statement(connection, f"DROP TABLE {quoted(f'tags_{self.names.run}')}")
            connection.commit()
        except Exception:
            connection.rollback()
            connection.close()
            self.abort(messages)
            raise
        connection.close()

    def abort(self, messages: list) -> None:
        connection = self.connect()
        for name in (self.names.stage, self.names.result, quoted(f"tags_{self.names.run}")):
            _statement(connection, f"DROP TABLE IF EXISTS {name}")
        connection.commit()
        connection.close()


def _source_of(connect: Callable, names: Names, label: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def writer(self, schema, overwrite):
            return _Writer(connect, names)

    return Source


def _one_by_one(connect: Callable, names: Names):
    """A task's rows (key, cells: array of (col, new)), each in a transaction of its own; what fails is reported and the rest goes on."""

    def run(batches) -> Iterator[pd.DataFrame]:
        connection = connect()
        where = " AND ".join(f"{quoted(c)} = ?" for c in names.keys)
        try:
            for b in batches:
                out = []
                for key, cells in zip(b["key"], b["cells"]):
                    cursor = connection.cursor()
                    try:
                        cursor.execute(f"UPDATE {names.table} SET {', '.join(f'{quoted(c["col"])} = ?' for c in cells)} WHERE {where}", (*(c["new"] for c in cells), *names.values(key)))
                        status, error = ("applied" if cursor.rowcount else "nomatch"), ""
                        connection.commit()
                    except Exception as e:
                        connection.rollback()
                        status, error = "error", f"{type(e).__name__}: {e}"
                    out.append((key, status, error))
                yield pd.DataFrame(out, columns=["key", "status", "error"])
        finally:
            connection.close()

    return run


def _results(spark: SparkSession, connect: Callable, names: Names) -> DataFrame:
    def run(batches) -> Iterator[pd.DataFrame]:
        connection = connect()
        try:
            for b in batches:
                for part in b["id"]:
                    cursor = connection.cursor()
                    cursor.execute(f"SELECT rowkey, status, error FROM {names.result} WHERE part = ?", (int(part),))
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=["key", "status", "error"])
        finally:
            connection.close()

    return spark.range(0, PARTS, 1, PARTS).mapInPandas(run, "key string, status string, error string")


def write_back(connect: Callable, table: str, plan: DataFrame, key_columns: Sequence[str], mode: str = "bulk", skip: Sequence[str] = ()) -> DataFrame:
    """Writes a plan of cells (key: JSON of the key columns, col, new) and gives (key, status, error) of each row, as a table that is
    kept in the shared folder.

    connect() opens a DB-API connection ("?" marks) and must pickle; the user may create tables. bulk: all changes in one
    transaction; if a task, a statement or the run fails nothing is written and the error is raised. row: each row in a
    transaction of its own, in the tasks; a row that fails is `error` with its reason, and one that a retried task writes again
    is set to the same values. A row that matches nothing is `nomatch` and counts as not applied. Of several values of a cell
    the greatest counts; keys in `skip` are left out; an empty plan gives an empty table."""
    if mode not in ("bulk", "row"):
        raise ValueError(mode)
    spark, names = plan.sparkSession, Names(table, key_columns, uuid.uuid4().hex[:12])
    cells = plan.where(~F.col("key").isin(*skip)).groupBy("key", "col").agg(F.max("new").alias("new"))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
    folder = shared_dir(spark)
    if mode == "row":
        rows = cells.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("col", "new"))).alias("cells"))
        return saved(rows.mapInPandas(_one_by_one(connect, names), "key string, status string, error string"), folder, "results")
    connection = connect()
    for sql in names.create():
        _statement(connection, sql)
    connection.commit()
    connection.close()
    label = f"writeback_{names.run}"
    spark.dataSource.register(_source_of(connect, names, label))
    try:
        cells.write.format(label).mode("append").save()
    except Exception:  # Spark calls abort() only if the writer's own tasks had begun
        _Writer(connect, names).abort([])
        raise
    out = saved(_results(spark, connect, names), folder, "results")
    connection = connect()
    _statement(connection, f"DROP TABLE {names.result}")
    connection.commit()
    connection.close()
    return out
