"""Staged tables: selection, keys and hashes, cell edits, dirty rows, conflicts with the source, dry runs, write-back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.tables import numbered, saved, shared_dir

ROWID, KEY, HASH, DIRTY = "__rowid", "__src_key", "__row_hash", "__dirty"


def select_rows(df: DataFrame, mode: str = "full", n: int = 1, where: str | None = None, order_by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """full and custom: all rows that match, in order; first_n: the first n; random_n: n rows by a seeded hash, so that the
    same rows come again."""
    out = df.where(where) if where else df
    order = [F.expr(o.rsplit(" ", 1)[0]).desc() if o.lower().endswith(" desc") else F.expr(o) for o in order_by]
    if mode == "random_n":
        return out.orderBy(F.xxhash64(F.lit(seed), F.struct(*out.columns))).limit(max(1, int(n)))
    out = out.orderBy(*order) if order else out
    return out.limit(max(1, int(n))) if mode == "first_n" else out


def key_json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def row_hash(columns: Sequence[str]) -> Column:
    """Of all source columns in order of name; nulls count, or rows that differ by one would look alike."""
    return F.sha1(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def stage(df: DataFrame, key: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """Adds a dense row id from 0, the source key, the row's hash and a clean flag.

    Rows with ties in the order are numbered by their hash, so a second import gives the same ids (equal rows are equal)."""
    columns = [c for c in df.columns if not c.startswith("__")]
    out = numbered(df, [*(order_by or key), row_hash(columns)], ROWID)
    return out.withColumns({KEY: key_json(key) if key else F.to_json(F.struct(ROWID)), HASH: row_hash(columns), DIRTY: F.lit(0)})


def edit(staged: DataFrame, edits: DataFrame, originals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(staged, originals) after edits (rowid, col, value, seq): the last edit of a cell wins, its first original is kept,
    the row is dirty. Unknown columns are an error."""
    columns = [c for c in staged.columns if not c.startswith("__")]
    if bad := [r.col for r in edits.where(~F.col("col").isin(*columns)).select("col").distinct().limit(5).collect()]:
        raise ValueError(f"unknown columns: {bad}")
    last = edits.groupBy("rowid", "col").agg(F.max_by("value", "seq").alias("value"))
    per_row = last.groupBy("rowid").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("__new"))
    joined = staged.join(per_row, staged[ROWID] == per_row["rowid"], "left").drop("rowid")
    new = {c: F.when(F.map_contains_key(F.col("__new"), F.lit(c)), F.col("__new")[c].try_cast(staged.schema[c].dataType)).otherwise(F.col(c)) for c in columns}
    changed = joined.withColumns({**new, DIRTY: F.when(F.col("__new").isNotNull(), 1).otherwise(F.col(DIRTY))}).drop("__new")
    old = long_form(staged.join(per_row.select("rowid"), F.col(ROWID) == F.col("rowid"), "left_semi"), columns).join(last.select("rowid", "col"), ["rowid", "col"], "left_semi")
    old = old.withColumnRenamed("value", "old")
    return changed, old if originals is None else originals.unionByName(old.join(originals.select("rowid", "col"), ["rowid", "col"], "left_anti"))


def long_form(staged: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])
    return staged.select(F.col(ROWID).alias("rowid"), F.explode(cells).alias("c")).select("rowid", "c.col", "c.value")


def dirty_changes(staged: DataFrame, originals: DataFrame) -> DataFrame:
    """(rowid, key, col, old, new) of every touched cell, also those changed back: one join for all columns."""
    columns = [c for c in staged.columns if not c.startswith("__")]
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("new")) for c in columns])
    now = staged.where(F.col(DIRTY) == 1).select(F.col(ROWID).alias("rowid"), F.col(KEY).alias("key"), F.explode(cells).alias("c")).select("rowid", "key", "c.col", "c.new")
    return now.join(originals, ["rowid", "col"]).select("rowid", "key", "col", "old", "new")


def conflicts(baseline: DataFrame, current: DataFrame, sampled: bool = False) -> DataFrame:
    """(key, status) from (key, hash) then and now: changed, deleted, unchanged and, unless only a sample was read, new."""
    both = baseline.select("key", F.col("hash").alias("then")).join(current.select("key", F.col("hash").alias("now")), "key", "full_outer")
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("then") == F.col("now"), "unchanged").otherwise("changed")
    out = both.select("key", status.alias("status"))
    return out.where(F.col("status") != "new") if sampled else out


def literal(value: Column, kind: str = "string") -> Column:
    """SQL text of a value: NULL, TRUE or FALSE, numbers as they are, everything else quoted."""
    text = value.cast("string")
    if kind == "boolean":
        text = F.upper(text)
    elif kind not in ("number", "int", "bigint", "double", "float", "smallint", "tinyint") and not kind.startswith("decimal"):
        text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def dry_run(changes: DataFrame, table: str, kinds: dict[str, str], source_columns: Sequence[str]) -> DataFrame:
    """(rowid, key, columns, statement): one UPDATE for each row over its changed columns that the source has."""
    known = changes.where(F.col("col").isin(*source_columns))
    value = literal(F.col("new"))
    for c, kind in kinds.items():
        value = F.when(F.col("col") == c, literal(F.col("new"), kind)).otherwise(value)
    sets = known.withColumn("set", F.concat(F.lit('"'), "col", F.lit('" = '), value))
    own = sets.groupBy("rowid", "key").agg(F.array_sort(F.collect_list("col")).alias("cols"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "set"))), lambda x: x["set"]), ", ").alias("sets"))
    conds = F.transform(F.map_entries(F.from_json("key", "map<string,string>")), lambda e: F.concat(F.lit('"'), e["key"], F.lit('" = '), F.when(e["value"].rlike(r"^-?\d+(\.\d+)?$"), e["value"]).otherwise(literal(e["value"]))))
    return own.select("rowid", "key", F.array_join("cols", ",").alias("columns"), F.concat(F.lit(f'UPDATE "{table}" SET '), "sets", F.lit(" WHERE "), F.array_join(conds, " AND ")).alias("statement"))


def skipped_columns(changes: DataFrame, source_columns: Sequence[str]) -> DataFrame:
    return changes.where(~F.col("col").isin(*source_columns)).select("col").distinct()


def bulk_groups(changes: DataFrame) -> DataFrame:
    """(columns, rows): rows that change the same set of columns share a prepared statement."""
    own = changes.groupBy("rowid").agg(F.array_join(F.array_sort(F.collect_set("col")), ",").alias("columns"))
    return own.groupBy("columns").agg(F.count("*").alias("rows"))


def retire(staged: DataFrame, originals: DataFrame, applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a write-back: applied cells lose their originals, rows without any are clean, all hashes are fresh."""
    left = originals.join(applied.select("rowid", "col"), ["rowid", "col"], "left_anti")
    columns = [c for c in staged.columns if not c.startswith("__")]
    open_rows = left.select(F.col("rowid").alias(ROWID), F.lit(1).alias("__open")).distinct()
    out = staged.join(open_rows, ROWID, "left").withColumn(DIRTY, F.coalesce("__open", F.lit(0))).drop("__open")
    return out.withColumn(HASH, row_hash(columns)).select(*staged.columns), left


def page(staged: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Rows by id; as ids are dense, a page is a range and no order over the table is needed."""
    return staged.where((F.col(ROWID) >= offset) & (F.col(ROWID) < offset + n)).orderBy(ROWID)


def count_rows(df: DataFrame, mode: str = "full", n: int = 1, where: str | None = None) -> DataFrame:
    """(n): how many rows a selection would take."""
    own = df.where(where) if where else df
    total = F.count("*")
    return own.agg((F.least(total, F.lit(max(1, int(n)))) if mode in ("first_n", "random_n") else total).cast("long").alias("n"))


def reread(source: DataFrame, keys: DataFrame, key_columns: Sequence[str]) -> DataFrame:
    """The rows of the source as they are now, of exactly the keys given (as source keys, in `key`): a sample is not drawn
    again. Spark sends the keys to the scan where they are few and joins by key where they are many."""
    return source.withColumn("__key", key_json(key_columns)).join(keys.select(F.col("key").alias("__key")).distinct(), "__key", "left_semi").drop("__key")


def current_hashes(source: DataFrame, staged: DataFrame, key_columns: Sequence[str], columns: Sequence[str], full: bool = True) -> DataFrame:
    """(key, hash) of the source now: of all rows where the whole table was staged (so new rows show), else of the staged
    keys alone; nothing without a key."""
    if not key_columns:
        return staged.where(F.lit(False)).select(F.col(KEY).alias("key"), F.col(HASH).alias("hash"))
    own = source if full else reread(source, staged.select(F.col(KEY).alias("key")), key_columns)
    return own.select(key_json(key_columns).alias("key"), row_hash(columns).alias("hash"))


def add_column(staged: DataFrame, name: str, kind: str = "string") -> DataFrame:
    """Adds a column of nulls, once."""
    return staged if name in staged.columns else staged.withColumn(name, F.lit(None).cast(kind))


def dry_run_report(statements: DataFrame, changes: DataFrame, source_columns: Sequence[str], max_rows: int = 50, max_columns: int = 20) -> DataFrame:
    """The first max_rows statements of dry_run() in order of row, with total_rows and truncated (rows or columns were left
    out)."""
    k = F.row_number().over(Window.orderBy("rowid"))  # Spark keeps max_rows of each task before the one window
    first = statements.orderBy("rowid").limit(max_rows + 1).withColumn("__k", k)
    wide = changes.where(F.col("col").isin(*source_columns)).groupBy("rowid").agg(F.count("*").alias("n")).where(F.col("n") > max_columns).limit(1).count() > 0
    total = statements.count()
    return first.where(F.col("__k") <= max_rows).drop("__k").withColumns({"total_rows": F.lit(total), "truncated": F.lit(total > max_rows or wide)})


def capped_changes(changes: DataFrame, source_columns: Sequence[str], max_columns: int = 20) -> DataFrame:
    """Changes of the first max_columns columns of each row, in order of name: what a dry run shows."""
    k = F.row_number().over(Window.partitionBy("rowid").orderBy("col"))
    return changes.where(F.col("col").isin(*source_columns)).withColumn("__k", k).where(F.col("__k") <= max_columns).drop("__k")


def process(staged: DataFrame, columns: Sequence[dict], generate, search=None, most: int = 4000) -> DataFrame:
    """(rowid, col, value, error, seq): fills columns in their order, one after the other, so that later templates see earlier
    results. A column is {name, kind: prompt or search, template}; generate and search take a list of texts and give a list.

    A search gives at most `most` characters; a row that fails keeps what it had and goes on to the next column. The values
    come as edits for edit(), so they pass the same checks as edits by hand."""
    from tessel.functions.text import fill, strip

    own = [c for c in staged.columns if not c.startswith("__") or c == ROWID]
    rows, edits, folder = staged.select(*own), [], shared_dir(staged.sparkSession)
    for seq, c in enumerate(columns):
        call, is_search = (search, True) if c["kind"] == "search" else (generate, False)
        values = {k: F.col(k) for k in rows.columns if k != ROWID}
        asked = rows.withColumn("__q", fill(F.lit(c["template"]), values)).withColumn("__q", strip("__q") if is_search else F.col("__q"))

        def run(batches, call=call, is_search=is_search):
            for b in batches:
                out = []
                for q in b["__q"]:
                    try:
                        if call is None:
                            raise RuntimeError("search is not available")
                        value = "" if is_search and not q else call([q])[0] or ""
                        out.append((value[:most] if is_search else value.strip(), None))
                    except Exception as e:
                        out.append((None, f"{type(e).__name__}: {e}"))
                yield b.assign(__v=[v for v, _ in out], __e=[e for _, e in out])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema), "__v string, __e string"])
        done = saved(asked.mapInPandas(run, schema), folder, f"column{seq}")  # each answer is asked for once
        edits.append(done.select(F.col(ROWID).alias("rowid"), F.lit(c["name"]).alias("col"), F.col("__v").alias("value"), F.col("__e").alias("error"), F.lit(seq).alias("seq")))
        old = F.col(c["name"]).cast("string") if c["name"] in rows.columns else F.lit(None).cast("string")
        rows = done.withColumn(c["name"], F.when(F.col("__e").isNull(), F.col("__v")).otherwise(old)).select(*dict.fromkeys([*rows.columns, c["name"]]))
    return reduce(DataFrame.unionByName, edits)


def plan_write_back(changes: DataFrame, source_columns: Sequence[str], key_columns: Sequence[str], found: DataFrame, approved: bool, on_conflict: str = "abort") -> DataFrame:
    """The changes that may be written, of columns that the source has: needs approval and a key, and `found`, the conflicts
    (key, status) as they are just now. abort: none if any row changed or is gone; skip: not those rows; overwrite: all."""
    if not approved:
        raise PermissionError("write-back was not approved")
    if not key_columns:
        raise ValueError("no key columns: rows of the source cannot be told")
    known = changes.where(F.col("col").isin(*source_columns))
    bad = found.where(F.col("status").isin("changed", "deleted")).select("key").distinct()
    if on_conflict == "overwrite":
        return known
    if on_conflict == "skip":
        return known.join(bad, "key", "left_anti")
    if not bad.isEmpty():
        raise RuntimeError("the source has changed since the import")
    return known


def applied(changes: DataFrame, audit: DataFrame) -> DataFrame:
    """The cells (rowid, col) that a write-back did write, by its audit (key, status): what matched nothing stays dirty."""
    return changes.join(audit.where("status = 'applied'").select("key"), "key", "left_semi").select("rowid", "col")
