"""Mixing sources to target weights: repetition rates from token totals, then whole copies plus one hash-seeded draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, saved, shared_dir, unused

#: Sizes are words; sources weigh these in turn; the mix takes this share of all words; no source is read more often.
WORD, WEIGHTS, SHARE, MAX_RATE = r"[^\x20\x09-\x0D]+", (5, 2, 1), 1.5, 2.0
#: Sources that may be broadcast, when counted.
BROADCAST_SOURCES = 10_000
DRAW_BITS = 52


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ordered(df: DataFrame, order: list, folder: str, name: str) -> DataFrame:
    """df sorted over partitions and written, with the partition and the place in it of each row."""
    here = F.monotonically_increasing_id()
    return saved(df.sort(*order).withColumns({"part": F.shiftright(here, 33), "at": here.bitwiseAND(F.lit((1 << 33) - 1))}), folder, name)


def _before(ordered: DataFrame, what: dict[str, str]) -> DataFrame:
    """Adds to rows of _ordered() the sums over all rows before each. Partitions are summed up in a table of one row for each, so no
    task runs over all rows."""
    sums = ordered.groupBy("part").agg(*[F.sum(c).alias(f"own_{name}") for name, c in what.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", *[F.coalesce(F.sum(f"own_{name}").over(earlier), F.lit(0)).alias(f"start_{name}") for name in what])
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return ordered.join(starts, "part").select(*ordered.columns, *[(F.col(f"start_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for name, c in what.items()])


def source_targets(sums: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target), one row for each source, the null source included.

    Sources in order of code points, null last, weigh `weights` in turn and share `share` of all words. A target stops at
    max_rate times its source's size and what is left over is shared again by weight until no target is above: with sources
    in order of size / weight those up to some place are at their stop, and the others share the rest. Places and sums come
    from sorted partitions, so there can be as many sources as there are hosts. An empty table gives an empty one.
    """
    folder = shared_dir(sums.sparkSession)
    # the order of code points is that of UTF-8 bytes, by which Spark compares strings
    ranked = _before(_ordered(sums.select("source", "source_size", F.lit(1).alias("one")), [F.col("source").asc_nulls_last()], folder, "by-name"), {"rank": "one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_rate))).alias("stop"))
    level = _before(_ordered(weighed, [F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()], folder, "by-level"), {"stopped": "stop", "passed": "weight"})
    total, weight = level.agg(F.sum("source_size") * F.lit(float(share)), F.sum("weight")).first()
    each = (F.lit(float(total or 0)) - F.col("stopped")) / (F.lit(float(weight or 0)) - F.col("passed"))
    # the first source whose stop is not below its share sets what a unit of weight gets; later ones would give less
    unit = level.where(F.col("stop") >= each * F.col("weight")).agg(F.max(each)).first()[0]
    target = F.col("stop") if unit is None else F.least("stop", F.lit(unit) * F.col("weight"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, max_rate: float = MAX_RATE, seed: int = 0) -> DataFrame:
    """Adds size, source_size, target and copies to every row of docs (in place of columns of these names).

    copies is floor(rate), rate = target / source_size, plus one with the probability of the fraction. The draw is a hash
    of the seed, the id, the text and the row's place among rows equal in both, so reruns and recomputed partitions agree, and
    rows with a null id or one id draw apart. Null texts have size 0; a source without words has rate 0. An empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = docs.drop("size", "source_size", "target", "copies")
    own, size, same, place = (unused(f"mix_{k}", docs) for k in ("source", "size", "same", "place"))
    text = F.col(text_col).cast("string")
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    known = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    sized = docs.withColumns({size: n_words(text), own: known, same: named})
    narrow = saved(sized.groupBy(F.col(own).alias("own"), F.col(same).alias("same")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("words")), folder, "narrow")
    sums = narrow.groupBy("own").agg(F.sum("words").alias("source_size")).select(F.when(~F.col("own.none"), F.col("own.name")).alias("source"), "source_size")
    targets = saved(source_targets(sums, weights, share, max_rate), folder, "targets")
    targets = targets.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias(own), "source_size", "target")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    again = saved(narrow.groupBy("same").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("same").alias(same)), folder, "again")
    placed = sized.withColumn(place, F.lit(1).cast("long")) if again.isEmpty() else _placed(sized, again, same, place, folder)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(same), F.lit(":"), F.col(place).cast("string")))
    draw = F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("double") / F.lit(float(2**DRAW_BITS))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")
    return placed.join(targets, own).select(*[f"`{c}`" for c in docs.columns], F.col(size).alias("size"), "source_size", "target", copies.alias("copies"))


def _placed(sized: DataFrame, again: DataFrame, same: str, place: str, folder: str) -> DataFrame:
    """Adds the place, from 1, of each row among rows of equal `same`, of which `again` holds those that come repeatedly.

    These rows are written with a deal of their own; places are counted within a deal, and begin after the deals before it, so a
    row that a third of the table repeats is not numbered in one task."""
    deal, n, start = (unused(f"mix_{k}", sized) for k in ("deal", "n", "start"))
    rows = saved(sized.join(again, same, "left_semi").withColumn(deal, F.shiftright(F.monotonically_increasing_id(), 12)), folder, "rows-again")
    counts = rows.groupBy(same, deal).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(same).orderBy(deal).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(same, deal, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(start))
    within = F.row_number().over(Window.partitionBy(same, deal).orderBy(F.lit(1)))
    numbered = rows.join(starts, [same, deal]).withColumn(place, F.col(start) + within).drop(deal, start)
    single = sized.join(again, same, "left_anti").withColumn(place, F.lit(1).cast("long"))
    return single.unionByName(numbered)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of mix_sources() as often as its copies say."""
    one = unused("mix_copy", mixed)
    return mixed.where("copies > 0").withColumn(one, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(one)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
         concat(doc_id, ':', md5(coalesce(text, ''))) AS same, row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) AS place FROM documents
), sums AS (
  SELECT source, sum(size)::bigint AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::double WHEN 1 THEN 2.0::double ELSE 1.0::double END AS weight,
         source_size * 2.0::double AS stop FROM sums
), levels AS (
  SELECT *, (sum(source_size) OVER ())::double * 1.5::double AS total,
         sum(stop) OVER w - stop AS stopped, sum(weight) OVER () - sum(weight) OVER w + weight AS open_weight
  FROM weighed WINDOW w AS (ORDER BY stop / weight, source NULLS LAST)
), units AS (
  SELECT *, (total - stopped) / open_weight AS each FROM levels
), unit AS (
  SELECT max(each) AS each FROM units WHERE stop >= each * weight
), targets AS (
  SELECT u.source, u.source_size, coalesce(least(u.stop, (SELECT each FROM unit) * u.weight), u.stop) AS target FROM units u
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('0:' || s.same || ':' || s.place), 1, 13))::bigint::double / 4503599627370496.0::double AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rate) + (draw < rate - floor(rate))::int) * size)::bigint AS taken FROM rated
"""
