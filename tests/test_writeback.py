import functools
import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessel.operators import staging
from tessel.sources import writeback


@pytest.fixture
def base(tmp_path):
    path = str(tmp_path / "people.db")
    with sqlite3.connect(path) as con:
        con.execute("create table people (id integer, place text, name text check (name <> 'bad'), note text, primary key (id, place))")
        con.executemany("insert into people values (?, ?, ?, ?)", [(k, "a\"b'é", f"n{k}", None) for k in range(3000) if k != 7])
    return functools.partial(sqlite3.connect, path, timeout=120)


def plan_of(spark, cells):
    key = lambda k: json.dumps({"id": k, "place": "a\"b'é"})
    return spark.createDataFrame([(key(k), col, new) for k, col, new in cells], "key string, col string, new string").repartition(5)


def tables(connect):
    return {r[0] for r in connect().execute("select name from sqlite_master where type = 'table'")}


def names(connect):
    return dict(connect().execute("select id, name from people"))


def status(audit):
    return {json.loads(r.key)["id"]: (r.status, r.error) for r in audit.collect()}


def test_bulk(spark, base):
    """Thousands of rows from several tasks in one transaction; rows that are gone, values with quotes and nulls, keys that change."""
    cells = [(k, "name", f"O'{k}") for k in range(0, 3000, 2)] + [(7, "name", "x"), (9, "note", None), (9, "name", "y"), (11, "id", "5011"), (11, "name", "moved")]
    got = status(writeback.write_back(base, "people", plan_of(spark, cells), ["id", "place"], skip=[json.dumps({"id": 4, "place": "a\"b'é"})]))
    assert got == {**{k: ("applied", "") for k in range(0, 3000, 2) if k != 4}, 7: ("nomatch", ""), 9: ("applied", ""), 11: ("applied", "")}
    now = names(base)
    assert all(now[k] == (f"O'{k}" if k != 4 else "n4") for k in range(0, 3000, 2)) and now[9] == "y" and now[5011] == "moved" and 11 not in now and now[1] == "n1"
    assert tables(base) == {"people"}


@pytest.mark.parametrize("cause", ["value", "plan", "task"])
def test_all_or_nothing(spark, base, cause, tmp_path):
    """A value that the database refuses, or a task that dies after others have sent their rows: nothing is written, nothing stays."""
    plan = plan_of(spark, [(k, "name", "bad" if k == 500 and cause == "value" else f"m{k}") for k in range(1000)])
    if cause == "task":  # in the writer, which reads the key
        plan = plan.unionByName(spark.createDataFrame([("{broken", "name", "x")], plan.schema))
    if cause == "plan":
        plan = plan.withColumn("new", F.when(F.col("key").contains('"id": 500,'), F.raise_error(F.lit("gone"))).otherwise(F.col("new")))
    before = names(base)
    with pytest.raises(Exception):  # noqa: B017
        writeback.write_back(base, "people", plan, ["id", "place"])
    assert names(base) == before and tables(base) == {"people"}


def test_a_task_that_runs_twice_counts_once(spark, base, tmp_path):
    """Cells of an attempt that did not report back are not applied."""
    own = writeback.Names("people", ["id", "place"], "r1")
    con = base()
    for sql in own.create():
        con.execute(sql)
    con.commit()
    writer = writeback._Writer(base, own)
    row = lambda k, new: {"key": json.dumps({"id": k, "place": "a\"b'é"}), "col": "name", "new": new, "part": 1}
    writer.write(iter([row(1, "lost"), row(2, "lost")]))
    good = writer.write(iter([row(1, "won")]))
    assert good.rows == 1
    writer.commit([good, None])
    assert (names(base)[1], names(base)[2]) == ("won", "n2")
    assert base().execute("select status from result_r1").fetchall() == [("applied",)]
    writer.abort([])
    assert tables(base) == {"people"}


def test_a_row_whose_cells_two_tasks_stage_is_one_result(spark, base):
    own = writeback.Names("people", ["id", "place"], "r2")
    con = base()
    for sql in own.create():
        con.execute(sql)
    con.commit()
    writer = writeback._Writer(base, own)
    row = lambda k, col: {"key": json.dumps({"id": k, "place": "a\"b'é"}), "col": col, "new": "x", "part": 1}
    writer.commit([writer.write(iter([row(k, col) for k in (1, 7)])) for col in ("name", "note")])
    assert base().execute("select status from result_r2 order by 1").fetchall() == [("applied",), ("nomatch",)]
    assert base().execute("select name, note from people where id = 1").fetchall() == [("x", "x")]


def test_row_by_row(spark, base):
    got = status(writeback.write_back(base, "people", plan_of(spark, [(1, "name", "a"), (2, "name", "bad"), (7, "name", "b"), (3, "name", "c"), (3, "note", None)]), ["id", "place"], "row"))
    assert {k: v[0] for k, v in got.items()} == {1: "applied", 2: "error", 7: "nomatch", 3: "applied"} and "IntegrityError" in got[2][1]
    assert [names(base)[k] for k in (1, 2, 3)] == ["a", "n2", "c"]


@pytest.mark.parametrize("mode", ["bulk", "row"])
def test_nothing_to_write(spark, base, mode):
    assert writeback.write_back(base, "people", plan_of(spark, [(1, "name", "a")]).limit(0), ["id", "place"], mode).count() == 0
    with pytest.raises(ValueError):
        writeback.write_back(base, "people", plan_of(spark, [(1, "name", "a")]), ["id"], "other")


def test_what_matched_nothing_stays_dirty(spark, base):
    changes = plan_of(spark, [(1, "name", "a"), (7, "name", "b")]).withColumn("rowid", F.get_json_object("key", "$.id").cast("long"))
    done = writeback.write_back(base, "people", changes, ["id", "place"])
    assert [tuple(r) for r in staging.applied(changes, done).collect()] == [(1, "name")]
    assert os.path.exists(base.args[0])


def test_staged_keys_are_found_by_index(base):
    """Each row of the table looks its cells up by its keys, it does not scan all staged cells of the column."""
    own, con = writeback.Names("people", ["id", "place"], "r"), base()
    for sql in [*own.create(), own.index()]:
        con.execute(sql)
    steps = [r[3] for r in con.execute("explain query plan " + own.update("name"), ("name", "name")) if "by_key_r" in r[3]]
    assert len(steps) == 2 and all("k0=? AND k1=?" in s for s in steps)
