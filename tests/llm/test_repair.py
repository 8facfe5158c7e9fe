import itertools
import random
import re
import zlib
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from tessel.llm import queries, repair
from tests import oracle

WHITE = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?")
KIND = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        blank = lambda x: " " if x is None else str(x)
        role, text, k = blank(role), blank(text), zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(rows):
    """Of a conversation's (role, text) rows in their order: the first fault of each."""
    out, seen = [], set()
    for row in rows:
        left = row[1].rstrip(WHITE)
        out.append("blank" if not left else "duplicate" if row in seen else "truncated" if left[-1] not in ".!?" else "none")
        seen.add(row)
    return out


def cheapest(rows):
    """(cost, audit, repaired rows), by the least costs to the end from each row and role, then the least edit again and again."""
    found = faults(rows)
    n, best = len(rows), {}

    def ways(i, last):
        new = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}
        yield "I", 2, i, new, (name[new], "")
        if i < n:
            role, text = rows[i]
            extra = int(found[i] == "truncated")
            yield "D", 3, i + 1, last, None
            if found[i] in ("none", "truncated"):
                yield "R", 2 + extra, i + 1, new, (name[new], text)
                if role[:1] == new or (last == "" and role[:1] == "s"):
                    yield "K", extra, i + 1, role[:1], (role, text)

    for i in range(n, -1, -1):
        for _ in range(4):  # inserts stay on a row: the least costs settle in a few rounds
            for last in ("", "s", "u", "a"):
                end = [0] if i == n and last in ("", "a") else []
                best[i, last] = min(end + [c + best[j, k] for _, c, j, k, _ in ways(i, last) if (j, k) in best], default=10**9)
    i, last, audit, out = 0, "", "", []
    while i < n or last not in ("", "a"):
        edit, _, i, last, row = min((w for w in ways(i, last) if w[1] + best[w[2], w[3]] == best[i, last]), key=lambda w: w[0])
        audit += edit
        out += [row] if row else []
    return best[0, ""], audit, out


def want(rows):
    """The whole result for (conv_id, turn, role, text) rows, after damage."""
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], md5(r[3].encode()).hexdigest()))
        pairs = [(r[2], r[3]) for r in own]
        found, turns = faults(pairs), [r[1] for r in own if r[1] is not None]
        cost, audit, made = cheapest(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


def collected(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_cheapest_against_all_scripts():
    """The plain solution itself, on all scripts of up to three rows."""
    name = {"u": "user", "a": "assistant"}
    for roles in itertools.chain(*(itertools.product(["system", "user", "assistant", "tool"], repeat=n) for n in range(4))):
        rows = [(r, ["Said.", "said", " "][(k + len(r)) % 3] + (str(k) if k % 2 else "")) for k, r in enumerate(roles)]
        found, scripts = faults(rows), []
        for ops in itertools.product("DKua", repeat=len(rows)):
            if any(o != "D" and f in ("blank", "duplicate") for o, f in zip(ops, found)):
                continue
            for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                said, audit, cost, made = "", "", 0, []
                for k in range(len(rows) + 1):
                    said, audit, cost = said + gaps[k], audit + "I" * len(gaps[k]), cost + 2 * len(gaps[k])
                    made += [(name[x], "") for x in gaps[k]]
                    if k < len(rows):
                        op, (role, text) = ops[k], rows[k]
                        audit += op if op in "DK" else "R"
                        cost += 3 if op == "D" else (0 if op == "K" else 2) + (found[k] == "truncated")
                        if op != "D":
                            said += role[:1] if op == "K" else op
                            made.append((role if op == "K" else name[op], text))
                if GOOD.fullmatch(said):
                    scripts.append((cost, audit, made))
        assert cheapest(rows) == min(scripts)


def kinds_of(rows):
    code = {"blank": repair.DROP, "duplicate": repair.DROP, "truncated": repair.CUT, "none": 0}
    return bytes((repair.INITIALS + r[:1]).index(r[:1]) + code[f] for (r, _), f in zip(rows, faults(rows)))


def test_divide_and_conquer():
    """Halves, and pieces of any sizes with their crossings, give the audit of the plain solution."""
    r = random.Random(3)
    for _ in range(400):
        rows = [(r.choice(["system", "user", "user", "assistant", "assistant", "xyz"]), r.choice([f"{k}.", f"{k}", "", "Yes."])) for k in range(r.randrange(0, 40))]
        kinds, (cost, audit, _) = kinds_of(rows), cheapest(rows)
        cuts = sorted({0, len(kinds), *(r.randrange(0, len(kinds) + 1) for _ in range(r.randrange(0, 6)))})
        parts = [kinds[a:b] for a, b in zip(cuts, cuts[1:])]
        states = repair.crossings([repair.matrix(p) for p in parts])
        got = "".join(repair.audit_between(p, a, b) for p, a, b in zip(parts, states, states[1:])) + repair.ENDS[states[-1]][1]
        assert (got, repair.cost_of(got, kinds)) == (audit, cost)


def mixed(seed, conversations=60):
    r = random.Random(seed)
    rows = []
    for c in [*range(conversations), None]:
        for t in range(r.randrange(1, 14)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((c, r.choice([t, t, t, t + 3, None]), role, r.choice([f"Said {t}.", f"said {t}", "Yes!", "", " \n", None, "x. \t\n", "ä?"])))
    one = {}
    for row in rows:  # ties of turn differ by role at most, so that their order is told by the docstring
        one.setdefault((row[0], row[1], row[2] or " "), row)
    return list(one.values())


@pytest.mark.parametrize("piece", [1 << 16, 3, 1])
def test_repair(spark, piece, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = mixed(piece)
    df = spark.createDataFrame(rows, KIND).repartition(3).withColumns({"part": F.lit(1), "at": F.lit("x"), "kind": F.lit(2), "copy": F.lit(3), "fault": F.lit(4), "audit": F.lit(5)})
    got = collected(repair.repair(repair.damaged(df), df))
    assert got == want(rows)
    assert any(x[3] and x[4] and x[1] for x in got.values())


def test_one_long_conversation(spark):
    """Thirty thousand rows under one id, over several partitions and pieces, beside a short one."""
    r = random.Random(8)
    rows = [(7, t, r.choice(["user", "assistant"]), r.choice([f"Said {t}.", f"cut {t}", "Yes."])) for t in range(30_000)] + [(8, 0, "user", "Hello.")]
    df = spark.createDataFrame(rows, KIND)
    assert collected(repair.repair(repair.damaged(df), df)) == want(rows)


def test_long_texts_repeats_and_nothing(spark):
    long = "word " * 500_000 + "."
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", "A" * 2_000_000), (2, None, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, KIND)
    assert collected(repair.repair(repair.damaged(df), df)) == want(rows)
    assert repair.repair(repair.damaged(df.limit(0)), df.limit(0)).count() == 0
    gone = [(c, t, "user", "x.") for c in range(200) for t in range(2) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    df = spark.createDataFrame(gone, KIND)
    assert set(collected(repair.repair(repair.damaged(df), df)).values()) == {(0, 0, 0, 0, 0, 0, "", sha256().hexdigest())}


@pytest.mark.skipif(not oracle.available(), reason="the driver's tables are not here")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.QUERIES["op13_repair"](spark, oracle.SF)) == want(rows)
