"""Repair of conversations: the cheapest edits that make their roles alternate, found by divide and conquer in linear space.

A conversation's roles, by their initials, must read `(s?(ua)+)?`. The automaton of that pattern has four states, and in each
of them one role only can be inserted or assigned, so an audit (the initials of the edits) fixes every role. A step over a row
therefore is a 4 x 4 matrix of costs. A forward vector from the start and a backward vector from the end meet in the middle;
of the states in which they cross at the least cost the one whose audit so far is least is kept, and both halves are solved
alike. Two audits up to the same row never begin with one another (both end in that row's edit), so the order of the states'
least audits is handed on as ranks, and no audit is held before it is known to be the answer.

The same cut works between tasks: rows are sorted over all partitions, a conversation is cut into pieces, each piece gives its
matrix, the matrices of a conversation meet in one small task, and pieces are solved apart between their crossing states.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import large_batches, saved, shared_dir, small_batches

#: Edits' costs; what a truncated row costs that is not deleted.
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Initials as numbers (3: any other); a row is its initial, plus DROP if it must go, plus CUT if it is truncated.
INITIALS, DROP, CUT = "sua", 4, 8
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What can be inserted in each, and what is kept.
START, NEXT, ALLOWED = 0, (2, 2, 3, 2), {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
#: Cost and inserts that lead from a state to the end.
ENDS = ((0, ""), (4, "II"), (2, "I"), (0, ""))
#: No way.
FAR = 1 << 60
#: Rows of a piece, at most.
PIECE = 1 << 16
WHITE = " \t\n\x0b\x0c\r"
ROLES = {2: "user", 3: "assistant"}


# ---- four-state vectors


@lru_cache(None)
def moves(kind: int) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """[from][to]: cost and edits (inserts, then the row's own) that lead over a row of this kind; None if nothing does."""
    initial, drop, extra = kind & 3, kind & DROP, TRUNCATED if kind & CUT else 0
    out = []
    for start in range(4):
        best: list[tuple[int, str] | None] = [None] * 4
        state = start
        for k in range(3):
            own = [(state, DELETE, "D")]
            if not drop:
                own.append((NEXT[state], RETYPE + extra, "R"))
                if state in ALLOWED[initial]:
                    own.append((ALLOWED[initial][state], extra, "K"))
            for to, cost, edit in own:
                one = (cost + INSERT * k, "I" * k + edit)
                best[to] = min(best[to] or one, one)
            state = NEXT[state]
        out.append(tuple(best))
    return tuple(out)


@lru_cache(1 << 16)
def _forward(costs: tuple[int, ...], ranks: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    found = []
    for to in range(4):
        ways = [(costs[s] + m[0], ranks[s], m[1]) for s in range(4) if costs[s] < FAR and (m := moves(kind)[s][to])]
        found.append(min(ways, default=(FAR, 4, "")))
    order = sorted({f[1:] for f in found})
    return tuple(f[0] for f in found), tuple(order.index(f[1:]) for f in found)


def forward(start: int, kinds: bytes) -> tuple[list[int], tuple[int, ...]]:
    """Least cost from a state over rows to each state, and the ranks of the least audits of that cost."""
    base, costs, ranks = 0, tuple(0 if s == start else FAR for s in range(4)), (0,) * 4
    for kind in kinds:
        costs, ranks = _forward(costs, ranks, kind)
        if (low := min(costs)) > 64:  # costs stay small, so that vectors come again
            base, costs = base + low, tuple(c - low if c < FAR else FAR for c in costs)
    return [c + base if c < FAR else FAR for c in costs], ranks


@lru_cache(1 << 16)
def _backward(costs: tuple[int, ...], kind: int) -> tuple[int, ...]:
    return tuple(min([m[0] + costs[to] for to, m in enumerate(row) if m and costs[to] < FAR], default=FAR) for row in moves(kind))


def backward(end: tuple[int, ...], kinds: bytes) -> list[int]:
    """Least cost of the rows from each state, the costs after them being `end`."""
    base, costs = 0, end
    for kind in reversed(kinds):
        costs = _backward(costs, kind)
        if (low := min(costs)) > 64:
            base, costs = base + low, tuple(c - low if c < FAR else FAR for c in costs)
    return [c + base if c < FAR else FAR for c in costs]


def crossing(costs: Iterable[int], ranks: Iterable[int], rest: Iterable[int]) -> int:
    """The state in which a forward and a backward vector meet at the least cost; of several, that of the least audit."""
    return min((c + r, rank, s) for s, (c, rank, r) in enumerate(zip(costs, ranks, rest)))[2]


def audit_between(kinds: bytes, start: int, end: int) -> str:
    """The least of the cheapest audits that lead over the rows from a state to a state. Space grows as the rows, time as the
    rows times the logarithm of their number."""
    out, todo = [], [(0, len(kinds), start, end)]
    only = {s: tuple(0 if t == s else FAR for t in range(4)) for s in range(4)}
    while todo:
        a, b, s, t = todo.pop()
        if b - a == 1:
            out.append(moves(kinds[a])[s][t][1])
        elif b > a:
            mid = (a + b) // 2
            meet = crossing(*forward(s, kinds[a:mid]), backward(only[t], kinds[mid:b]))
            todo += [(mid, b, meet, t), (a, mid, s, meet)]
    return "".join(out)


def matrix(kinds: bytes) -> list[int]:
    """Sixteen costs and sixteen ranks, a row of four for each state at the start."""
    rows = [forward(s, kinds) for s in range(4)]
    return [c for costs, _ in rows for c in costs] + [r for _, ranks in rows for r in ranks]


def crossings(matrices: list[list[int]]) -> list[int]:
    """The state before each piece and after the last one, of the audit-least of the cheapest ways over all pieces."""
    costs, ranks, reached = [0 if s == START else FAR for s in range(4)], [0] * 4, []
    for m in matrices:
        found = []
        for to in range(4):
            ways = [(costs[s] + m[4 * s + to], ranks[s], m[16 + 4 * s + to]) for s in range(4) if costs[s] < FAR and m[4 * s + to] < FAR]
            found.append(min(ways, default=(FAR, 4, 4)))
        order = sorted({f[1:] for f in found})
        costs, ranks = [f[0] for f in found], [order.index(f[1:]) for f in found]
        reached.append((costs, ranks))
    rest, out = [e[0] for e in ENDS], []
    for m, (costs, ranks) in zip(reversed(matrices), reversed(reached)):
        out.append(crossing(costs, ranks, rest))
        rest = [min(m[4 * s + t] + rest[t] for t in range(4)) for s in range(4)]
    return [START, *reversed(out)]


def cost_of(audit: str, kinds: bytes) -> int:
    at, total = 0, 0
    for edit in audit:
        if edit == "I":
            total += INSERT
            continue
        total += {"K": 0, "R": RETYPE, "D": DELETE}[edit] + (TRUNCATED if edit != "D" and kinds[at] & CUT else 0)
        at += 1
    return total


# ---- tables


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that a checksum of id and turn chooses: 0 of 20 drops a row, 1 empties its
    text, 2 takes its `.!?`, 3 repeats it, 4 makes it a user's. A null is one space (but stays null in conv_id and turn)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("fault"))
    fault, text = F.col("fault"), F.col("text")
    rows = rows.where(fault != 0).withColumn("text", F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text))
    rows = rows.withColumn("role", F.when(fault == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _ordered(rows: DataFrame, folder: str) -> DataFrame:
    """The rows sorted over all partitions, with their partition and place: a long conversation is spread over several."""
    here = F.monotonically_increasing_id()
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.md5("text")]
    rows = rows.select("conv_id", "turn", "role", "text").sort(*order)
    return saved(rows.withColumns({"part": F.shiftright(here, 33), "at": here.bitwiseAND(F.lit((1 << 33) - 1))}), folder, "ordered")


def _faulted(ordered: DataFrame) -> DataFrame:
    """(conv_id, turn, part, at, initial, fault): the first fault of each row: blank, duplicate, truncated or none."""
    text, initial = F.col("text"), F.substring("role", 1, 1)
    known = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    same = F.unhex(F.sha2(F.concat_ws(":", known, F.length("role").cast("string"), "role", "text"), 256))
    blank = ~text.rlike(f"[^{WHITE}]")
    cut = ~F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1)).isin(".", "!", "?")
    rows = ordered.select("conv_id", "turn", F.struct("part", "at").alias("place"), F.coalesce(*[F.when(initial == x, k) for k, x in enumerate(INITIALS)], F.lit(3)).alias("initial"), same.alias("same"), blank.alias("blank"), cut.alias("cut"))
    first = rows.groupBy("same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(F.col("cut"), "truncated").otherwise("none")
    return rows.join(first, "same", "left").select("conv_id", "turn", "place.part", "place.at", "initial", fault.alias("fault"))


def _runs(keys: list[list]) -> Iterator[tuple[int, int]]:
    """Start and end of runs of equal entries over all lists."""
    a = 0
    for k in range(1, len(keys[0]) + 1):
        if k == len(keys[0]) or any(c[k] != c[a] for c in keys):
            yield a, k
            a = k


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, part, at, kind) in their order -> pieces (conv_id, part, at, kinds, matrix, illegal)."""
    small = lru_cache(1 << 15)(lambda kinds: (matrix(kinds), _illegal(kinds)))
    key, kinds = None, bytearray()

    def piece() -> tuple:
        own = bytes(kinds)
        return (*key, own, *(small(own) if len(own) <= 64 else (matrix(own), _illegal(own))))

    for batch in batches:
        conv, part, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        kind, out = batch.column(3).to_numpy().astype(np.uint8).tobytes(), []
        for a, b in _runs([conv, part]):
            more = key is not None and key[:2] == (conv[a], part[a]) and key[2] + len(kinds) == at[a]
            while a < b:
                if not more or len(kinds) == PIECE:
                    if key is not None:
                        out.append(piece())
                    key, kinds, more = (conv[a], part[a], at[a]), bytearray(), True
                stop = a + 1
                while stop < b and at[stop] == at[a] + stop - a and stop - a + len(kinds) < PIECE:
                    stop += 1
                kinds += kind[a:stop]
                more, a = stop >= b or at[stop] == at[stop - 1] + 1, stop
        if out:
            yield _piece_rows(out)
    if key is not None:
        yield _piece_rows([piece()])


PIECE_KIND = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("kinds", pa.binary()), ("matrix", pa.list_(pa.int64())), ("illegal", pa.int64())])


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECE_KIND)], schema=PIECE_KIND)


def _illegal(kinds: bytes) -> int:
    return sum((a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(kinds, kinds[1:]))


def _crossed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces' matrices (conv_id, part, at, matrix) in their order -> (part, at, before, after, last), a conversation at a time."""
    none = object()
    conv, held = none, []

    def solved() -> list[tuple]:
        states = crossings([m for _, _, m in held])
        return [(part, at, states[k], states[k + 1], k + 1 == len(held)) for k, (part, at, _) in enumerate(held)]

    for batch in batches:
        out = []
        for c, part, at, m in zip(*(col.to_pylist() for col in batch.columns)):
            if c != conv or conv is none:
                out += solved() if held else []
                conv, held = c, []
            held.append((part, at, m))
        if out:
            yield _crossing_rows(out)
    if held:
        yield _crossing_rows(solved())


CROSSING_KIND = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("last", pa.bool_())])


def _crossing_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CROSSING_KIND)], schema=CROSSING_KIND)


def _solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, part, at, kinds, before, after, last) -> (conv_id, part, at, before, audit, cost)."""

    def solve(kinds: bytes, before: int, after: int, last: bool) -> tuple[str, int]:
        audit = audit_between(kinds, before, after) + (ENDS[after][1] if last else "")
        return audit, cost_of(audit, kinds)

    small = lru_cache(1 << 15)(solve)
    for batch in batches:
        conv, part, at, kinds, before, after, last = (c.to_pylist() for c in batch.columns)
        found = [(small if len(k) <= 64 else solve)(k, b, a, x) for k, b, a, x in zip(kinds, before, after, last)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], ["conv_id", "part", "at", "before", "audit", "cost"])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, audit, before, role, text) in their order, each piece's audit before its rows -> (conv_id, sha256).

    A running hash takes the rows one after the other, so memory does not follow a conversation's length."""
    none = object()
    conv, digest, first, audit, k, state = none, sha256(), True, "", 0, START

    def put(role: str, text: str) -> None:
        nonlocal first
        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False

    def inserts() -> None:
        nonlocal k, state
        while k < len(audit) and audit[k] == "I":
            state = NEXT[state]
            put(ROLES[state], "")
            k += 1

    done: list[tuple] = []
    for batch in batches:
        for c, own, before, role, text in zip(*(col.to_pylist() for col in batch.columns)):
            if conv is none or c != conv:
                if conv is not none:
                    done.append((conv, digest.hexdigest()))
                conv, digest, first = c, sha256(), True
            if own is not None:
                audit, k, state = own, 0, before
            else:
                edit = audit[k]
                k += 1
                if edit == "K":
                    state = ALLOWED[INITIALS.find(role[:1])][state]
                    put(role, text)
                elif edit == "R":
                    state = NEXT[state]
                    put(ROLES[state], text)
            inserts()
        if len(done) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], ["conv_id", "sha"])
            done = []
    if conv is not none:
        done.append((conv, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["conv_id", "sha"])


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows
    (conv_id long, turn, role, text), and of those that only `ids` names: zeros, an empty audit, the hash of nothing.

    Rows are taken by turn, nulls first, then by role and a hash of the text; equal rows stay as often as they come. A null id
    is a conversation of its own; roles and texts must not be null (see `damaged`). Other columns are not read. A conversation
    of any length is solved in pieces of up to PIECE rows; only the hash of its repaired text runs through its rows in one
    task, as SHA-256 must, without holding them. An empty table gives an empty result."""
    spark = rows.sparkSession
    folder = shared_dir(spark)
    large_batches(spark)
    ordered = _ordered(rows.withColumn("conv_id", F.col("conv_id").cast("long")), folder)
    faulted = saved(_faulted(ordered), folder, "faulted")
    kind = F.col("initial") + F.when(F.col("fault").isin("blank", "duplicate"), DROP).when(F.col("fault") == "truncated", CUT).otherwise(0)
    lined = faulted.select("conv_id", "part", "at", kind.alias("kind")).repartition("part", F.shiftright("at", 16)).sortWithinPartitions("part", "at")
    pieces = saved(lined.mapInArrow(_pieces, "conv_id long, part long, at long, kinds binary, matrix array<long>, illegal long"), folder, "pieces")
    in_order = pieces.select("conv_id", "part", "at", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    states = in_order.mapInArrow(_crossed, "part long, at long, before int, after int, last boolean")
    solved = pieces.select("conv_id", "part", "at", "kinds").join(states, ["part", "at"]).select("conv_id", "part", "at", "kinds", "before", "after", "last")
    solved = saved(solved.mapInArrow(_solved, "conv_id long, part long, at long, before int, audit string, cost long"), folder, "solved")

    both = solved.select("conv_id", "part", "at", "audit", "before", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"))
    both = both.unionByName(ordered.select("conv_id", "part", "at", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("int").alias("before"), "role", "text", F.lit(1).alias("kind")))
    lines = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at", "kind").select("conv_id", "audit", "before", "role", "text")
    small_batches(spark)
    hashes = lines.mapInArrow(_hashed, "conv_id long, sha string")
    turns = faulted.where(F.col("turn").isNotNull()).groupBy("conv_id", "turn").count().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    counts = faulted.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    ends = pieces.select("conv_id", "part", "at", F.substring("kinds", 1, 1).alias("first"), F.substring("kinds", -1, 1).alias("last"), "illegal")
    audits = solved.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "audit"))), lambda x: x["audit"])).alias("audit"))
    met = ends.groupBy("conv_id").agg(F.sum("illegal").alias("inside"), F.array_sort(F.collect_list(F.struct("part", "at", "first", "last"))).alias("e"))
    code = lambda b: F.conv(F.hex(b), 16, 10).cast("int").bitwiseAND(3)
    joint = lambda k: ~F.array_contains(F.lit(["0-1", "1-2", "2-1"]), F.concat_ws("-", code(F.element_at("e", k)["last"]), code(F.element_at("e", k + 1)["first"])))
    between = F.when(F.size("e") > 1, F.size(F.filter(F.sequence(F.lit(1), F.size("e") - 1), joint))).otherwise(0)
    met = met.select("conv_id", (F.col("inside") + between).alias("illegal"))

    parts = [turns, counts, audits, met, hashes] + ([ids.select(F.col("conv_id").cast("long").alias("conv_id"))] if ids is not None else [])
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    whole = lambda c: F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c)
    return every.groupBy("conv_id").agg(
        *[whole(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.lit(sha256().hexdigest())).alias("repaired_sha256")
    )


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(rows), rows)
