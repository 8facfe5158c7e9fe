"""Filter interaction audit: what every order of a set of filters keeps, removes and makes redundant.

A document's failures are one mask; documents of a part (a source) and a mask are one cell. Each cell is folded across the
array of all orders by higher-order functions, which gives a weighted struct for each order and step, and the cells of a part
are merged by elementwise sums. Only masks travel: texts are read once and reduced to a digest and a few bits in their task.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved, shared_dir

#: White space between words.
SPACE = "[ \\t-\\r]+"
#: What a step's struct holds: the order's number, the place in it and the filter's bit; counts of documents.
PLACE, COUNTS = ["at", "step", "bit"], ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
#: Partitions' share of rows without an id, which no label matches: they are dealt out.
DEALT = 64


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


#: Letter -> whether a text fails; the letter DUPLICATE stands for a text that a smaller id has too.
FAILURES: dict[str, Callable[[Column], Column]] = {
    "A": lambda t: F.size(_words(t)) < 200,
    "B": lambda t: 100 * F.size(F.array_distinct(_words(t))) < 50 * F.size(_words(t)),
    "C": lambda t: 100 * F.regexp_count(t, F.lit("[A-Z]")) > 2 * F.length(t),
    "D": lambda t: t.rlike("[#$%&*|]"),
}
DUPLICATE = "E"


def masks(docs: DataFrame, labels: DataFrame, failures: dict[str, Callable[[Column], Column]] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): the cells, without those that have no document.

    Bit k of a mask is the k-th filter in the order of `failures`, the last one being DUPLICATE. A null text is an empty one,
    a null part the empty string. An id that is null is larger than all others and has no label; rows of one id and text do
    not make each other duplicates. An id with several labels counts as good (toxic) if one of them says so. Only the columns
    named are read, so others may have any name."""
    failures = FAILURES if failures is None else failures
    folder = shared_dir(docs.sparkSession)
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    bits = sum((F.when(fails(text), 1 << k).otherwise(0) for k, fails in enumerate(failures.values())), F.lit(0))
    rows = docs.select(key.alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("bits"))
    rows = rows.groupBy("id", "part", "digest", "bits").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("deal", F.when(F.col("id").isNull(), F.pmod(F.hash("digest"), F.lit(DEALT))).otherwise(0))
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"is_{c}")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(says("quality"), says("toxic")).withColumn("deal", F.lit(0))
    rows = saved(rows.join(marks, ["id", "deal"], "left").drop("deal"), folder, "rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("holders")).where("holders > 1 and first is not null").drop("holders")
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    mask = F.col("bits") + F.when(later, 1 << len(failures)).otherwise(0)
    weigh = lambda c: F.sum(F.when(F.col(f"is_{c}") == 1, F.col("n")).otherwise(0))
    return rows.join(first, "digest", "left").groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), weigh("quality").alias("good"), weigh("toxic").alias("toxic"))


def _steps(cell: Column, orders: Column) -> Column:
    """The structs of all orders and steps, one after the other, that the documents of a cell add to."""

    def step(at: Column) -> Callable[[Column, Column], Column]:
        def add(so_far: Column, bit: Column) -> Column:
            fails, before = cell["mask"].bitwiseAND(bit) != 0, so_far["seen"].bitwiseAND(cell["mask"]) != 0
            here = fails & ~before
            only = lambda when, c="n": F.when(when, cell[c]).otherwise(F.lit(0).cast("long"))
            counts = [only(~fails & ~before), only(here), only(fails & before), only(cell["mask"] == bit), only(here, "good"), only(here, "toxic")]
            one = F.struct(at.alias("at"), (F.size(so_far["steps"]) + 1).alias("step"), bit.alias("bit"), *[c.alias(name) for c, name in zip(counts, COUNTS)])
            return F.struct(so_far["seen"].bitwiseOR(bit).alias("seen"), F.concat(so_far["steps"], F.array(one)).alias("steps"))

        return add

    kind = f"array<struct<{', '.join(f'{c}: int' for c in PLACE)}, {', '.join(f'{c}: bigint' for c in COUNTS)}>>"
    start = F.struct(F.lit(0).alias("seen"), F.array().cast(kind).alias("steps"))
    return F.flatten(F.transform(orders, lambda order, at: F.aggregate(order, start, step(at), lambda s: s["steps"])))


def fold_orders(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, *COUNTS, shapley) of cells (part, mask, n, good, toxic): a row for each part, order of the
    letters and step. A part has at most 2 ** len(letters) cells, so gathering them is bounded; there are len(letters)! orders,
    so use it for up to some six filters. Parts without cells, and an empty table, give no rows."""
    named = ["".join(p) for p in permutations(letters)]
    bits = [1 << k for k in range(len(letters))]
    orders = F.lit([[bits[letters.index(x)] for x in order] for order in named])
    add = lambda x, y: F.struct(*[y[c].alias(c) for c in PLACE], *[(x[c] + y[c]).alias(c) for c in COUNTS])
    zero = F.struct(*[F.lit(0).alias(c) for c in PLACE], *[F.lit(0).cast("long").alias(c) for c in COUNTS])

    def by_filter(steps: Column) -> Column:
        """Each filter's steps in all orders, with the sum of what it removes in them."""
        own = lambda bit: F.filter(steps, lambda x: x["bit"] == bit)
        return F.transform(F.lit(bits), lambda bit: F.struct(own(bit).alias("steps"), F.aggregate(own(bit), F.lit(0).cast("long"), lambda s, x: s + x["removed"]).alias("shapley")))

    merged = F.aggregate("cells", F.array_repeat(zero, len(named) * len(letters)), lambda all_, cell: F.zip_with(all_, _steps(cell, orders), add), by_filter)
    rows = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).select("part", F.explode(merged).alias("f"))
    rows = rows.select("part", F.col("f.shapley").alias("shapley"), F.explode("f.steps").alias("s"))
    return rows.select("part", F.element_at(F.lit(named), F.col("s.at") + 1).alias("filter_order"), F.col("s.step").alias("step"), *[F.col(f"s.{c}").alias(c) for c in COUNTS], "shapley")


def audit(docs: DataFrame, labels: DataFrame, failures: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """All orders of the filters (and of DUPLICATE) over the parts of docs; see `masks` and `fold_orders`."""
    failures = FAILURES if failures is None else failures
    return fold_orders(masks(docs, labels, failures), "".join(failures) + DUPLICATE)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failed AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), min(doc_id) OVER (PARTITION BY text) IS NOT NULL) AS e,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM doc LEFT JOIN marks USING (doc_id)
), cell AS (
  SELECT part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY 1, 2
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM f p, f q, f r, f s, f t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), step AS (
  SELECT filter_order, k AS step, 1 << (ascii(filter_order[k]) - 65) AS own,
    coalesce(list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(filter_order[j]) - 65))), 0)::int AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & own = 0 AND mask & before = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, step GROUP BY ALL
)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
  good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM counted
"""
