"""Secret scans with linking of multipart credentials, by DataFrame functions only.

Strong patterns report their matches as they are. Weak ones (an access identifier, a secret or an endpoint by shape alone)
are reported only where complementary parts meet: an interval join within each row links identifiers and secrets that lie
apart by SCOPE code points at most, and endpoints that are as near to both. The join is by equality of bins of that width,
so it is in proportion to the spans: parts do not overlap, and only so many fit into a scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, saved, shared_dir

#: Code points between the parts of one credential at most.
SCOPE = 200

#: Strong patterns, in the order of their kinds: regular expression, group that must be long, characters that it must have.
#: Where a match is one run of a class, the least length stands in the pattern: a shorter run can hold no match either way.
STRONG = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak patterns: regular expression, part of a credential that it may be.
WEAK = {
    "weak_id": (r"\b(?=[A-Z0-9]{0,40}[0-9])[A-Z][A-Z0-9]{15,40}\b", "id"),
    "weak_secret": (r"(?<![A-Za-z0-9+/=_-])(?=[^0-9\s]{0,80}[0-9])(?=[^A-Z\s]{0,80}[A-Z])[A-Za-z0-9+/_-]{32,80}={0,2}(?![A-Za-z0-9+/=_-])", "secret"),
    "endpoint": (r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?", "endpoint"),
}
#: What a strong match stands for when parts are linked.
PARTS = {"assign": "secret", "access": "id", "hex": "secret"} | {k: part for k, (_, part) in WEAK.items()}
KINDS = [*STRONG, *WEAK]
NONE = -1


def _matches(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Array of (kind, gap, size, good): each match with the code points between the one before and it.

    A split by the pattern gives the gaps; only texts with a match are searched again for the matches themselves.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    good = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"), found.alias("hit"), good.alias("part")),
        lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["part"]) >= least).alias("good")),
    )
    return F.when(text.rlike(pattern), rows)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, kind, start, end) for every candidate of every row of docs; and one of kind NONE for every row.

    Positions count code points, the end is exclusive; kind is a place in KINDS. row tells rows of one id apart.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    specs = [(p, g, n) for p, g, n in STRONG.values()] + [(p, 0, 1) for p, _ in WEAK.values()]
    none = F.array(F.struct(F.lit(NONE).alias("kind"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(True).alias("good")))
    found = F.flatten(F.array_compact(F.array(none, *[_matches(F.col("__text"), k, *s) for k, s in enumerate(specs)])))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("__text"))
    each = rows.select("doc_id", "row", F.posexplode(found).alias("pos", "m")).select("doc_id", "row", "pos", "m.*")
    until = Window.partitionBy("row", "doc_id", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.col("size")).over(until)
    return each.withColumn("end", end).where("good").select("row", "doc_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def candidates(found: DataFrame) -> DataFrame:
    """spans() by part, without weak spans that overlap a strong one: these are the same string again."""
    part = F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate(PARTS[n] for n in KINDS) for x in (k, v)]), F.col("kind"))
    one, strong = Window.partitionBy("row").orderBy("start"), F.col("kind") < len(STRONG)
    before = F.max(F.when(strong, F.col("end"))).over(one.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(strong, F.col("start"))).over(one.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    marked = found.where(F.col("kind") != NONE).withColumns({"part": part, "before": before, "after": after})
    again = F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False))
    return marked.where(strong | ~again).drop("before", "after")


def _gap(a: str, b: str) -> Column:
    """Code points between two spans; below 0 if they overlap."""
    return F.greatest(f"{a}_start", f"{b}_start") - F.least(f"{a}_end", f"{b}_end")


def _near(left: DataFrame, a: str, parts: DataFrame, b: str, scope: int, how: str = "inner") -> DataFrame:
    """left with each span of part b that lies apart from its span a by scope at most, as b_kind, b_start and b_end.

    Spans take part in every bin that they touch, those of b in the bins of their surroundings; a pair is taken in the
    first bin that both have."""
    bins = lambda low, high: F.sequence(F.floor(low / scope), F.floor(high / scope))
    own = parts.where(F.col("part") == b).select(F.col("row").alias("b_row"), *[F.col(c).alias(f"{b}_{c}") for c in ("kind", "start", "end")])
    own = own.withColumn("b_bin", F.explode(bins(F.col(f"{b}_start") - scope, F.col(f"{b}_end") + scope)))
    left = left.withColumn("a_bin", F.explode(bins(F.col(f"{a}_start"), F.col(f"{a}_end"))))
    first = F.greatest(F.floor(F.col(f"{a}_start") / scope), F.floor((F.col(f"{b}_start") - scope) / scope))
    on = (F.col("row") == F.col("b_row")) & (F.col("a_bin") == F.col("b_bin")) & (F.col("a_bin") == first) & _gap(a, b).between(0, scope)
    return left.join(own, on, how).drop("b_row", "a_bin", "b_bin")


def links(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, doc_id, id_kind, id_start, id_end, secret_..., endpoint_...): each pair of an identifier and a secret that lie apart
    by scope at most, with each endpoint that is as near to both; the endpoint's columns are null if there is none.

    Parts that overlap are no pair. Equal spans of repeated rows give links of each row."""
    parts = candidates(found)
    ids = parts.where(F.col("part") == "id").select("row", "doc_id", *[F.col(c).alias(f"id_{c}") for c in ("kind", "start", "end")])
    pairs = _near(ids, "id", parts, "secret", scope)
    full = _near(pairs, "id", parts, "endpoint", scope).where(_gap("secret", "endpoint").between(0, scope))
    keys = ["row", "id_kind", "id_start", "secret_kind", "secret_start"]
    return pairs.join(full.select(*keys, "endpoint_kind", "endpoint_start", "endpoint_end"), keys, "left").select("row", "doc_id", *[f"{p}_{c}" for p in ("id", "secret", "endpoint") for c in ("kind", "start", "end")])


def reported(found: DataFrame, linked: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end): the strong spans of spans(), the weak ones of links(), and one of kind NONE a row."""
    each = F.explode(F.array(*[F.struct(*[F.col(f"{p}_{c}").alias(c) for c in ("kind", "start", "end")]) for p in ("id", "secret", "endpoint")])).alias("s")
    weak = linked.select("row", "doc_id", each).select("row", "doc_id", "s.*").where(F.col("kind") >= len(STRONG)).distinct()
    return found.where(F.col("kind") < len(STRONG)).unionByName(weak)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans: array of (start, end, kind), n_links) for every row of docs, in order of start, then of KINDS.

    A null or empty text has no spans; a null id is kept; repeated rows are reported each; an empty table gives an empty
    one. Other columns are not read. The spans are written to the shared folder first, so that rows keep their numbers.
    """
    folder = shared_dir(docs.sparkSession)
    found = saved(spans(docs, id_col, text_col), folder, "spans")
    linked = saved(links(found, scope), folder, "links")
    span = F.when(F.col("kind") != NONE, F.struct("start", "kind", "end"))
    out = reported(found, linked).groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("s"))
    counts = linked.groupBy("row").agg(F.count("*").alias("n_links"))
    name = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(name, x["kind"] + 1).alias("kind")))
    return out.join(counts, "row", "left").select("doc_id", each.alias("spans"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*STRONG))
    return found.select("doc_id", *[count(k) for k in STRONG], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_links")
