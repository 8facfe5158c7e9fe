"""A query that writes: changes of customers go back to a database and its rows are read again."""

from __future__ import annotations

import functools
import os
import sqlite3

import pandas as pd
from pyspark.sql import functions as F

from tessel.operators import staging as S
from tessel.plans.registry import query, table
from tessel.plans.tables import _CHANGES, _SOURCE, changed
from tessel.sources import writeback
from tessel.tables import saved, shared_dir

#: Parts that tasks load the table in and read it by.
PARTS = 8


def _database(spark) -> functools.partial:
    """Connections to a new database file in the shared folder."""
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    return functools.partial(sqlite3.connect, f"{folder}/source.db", timeout=300)


def _loaded(rows, connect) -> None:
    """Writes customers to the database, by tasks; a task that runs again replaces its rows."""

    def run(batches):
        con = connect()
        for b in batches:
            con.executemany("INSERT OR REPLACE INTO customer VALUES (?, ?, ?)", b.astype(object).values.tolist())
            con.commit()
            yield pd.DataFrame({"n": [len(b)]})
        con.close()

    rows.repartition(PARTS).mapInPandas(run, "n long").agg(F.sum("n")).collect()


def _read(spark, connect):
    def run(batches):
        con = connect()
        for b in batches:
            for k in b["id"]:
                yield pd.DataFrame(con.execute(f"SELECT c_custkey, c_name, c_nationkey FROM customer WHERE abs(c_custkey % {PARTS}) = ?", (int(k),)).fetchall(), columns=["c_custkey", "c_name", "c_nationkey"])
        con.close()

    return spark.range(0, PARTS, 1, PARTS).mapInPandas(run, "c_custkey long, c_name string, c_nationkey long")


@query(f"""WITH {_CHANGES}, known AS (SELECT c_custkey, key, max(new) FILTER (col = 'c_name') AS name, max(new) FILTER (col = 'c_nationkey') AS nation FROM changes WHERE col <> 'note' GROUP BY 1, 2)
SELECT c.c_custkey, CASE WHEN k.key IS NULL THEN 'same' WHEN c.c_custkey % 8 = 4 THEN 'nomatch' ELSE 'applied' END AS status,
  CASE WHEN c.c_custkey % 8 <> 4 THEN coalesce(k.name, c.c_name) END AS c_name, CASE WHEN c.c_custkey % 8 <> 4 THEN coalesce(k.nation::bigint, c.c_nationkey) ELSE -1 END AS c_nationkey
FROM customer c LEFT JOIN known k USING (c_custkey)""")
def write_back(spark, sf_dir):
    """All changes in one transaction; some of the rows are gone from the database since they were staged."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    connect = _database(spark)
    with connect() as con:
        con.execute("CREATE TABLE customer (c_custkey INTEGER PRIMARY KEY, c_name TEXT, c_nationkey INTEGER)")
    con.close()
    _loaded(customers.where("c_custkey % 8 <> 4"), connect)
    changes = S.dirty_changes(*changed(spark, sf_dir))
    plan = S.plan_write_back(changes, _SOURCE, ["c_custkey"], spark.createDataFrame([], "key string, status string"), True)
    done = writeback.write_back(connect, "customer", plan, ["c_custkey"])
    now = saved(_read(spark, connect), shared_dir(spark), "now")
    status = done.select(F.get_json_object("key", "$.c_custkey").cast("long").alias("c_custkey"), "status")
    found = customers.select("c_custkey").join(status, "c_custkey", "left").join(now.withColumn("there", F.lit(True)), "c_custkey", "left")
    return found.select("c_custkey", F.coalesce("status", F.lit("same")).alias("status"), "c_name", F.when(F.col("there"), F.col("c_nationkey")).otherwise(-1).alias("c_nationkey"))
