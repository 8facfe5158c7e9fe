import io
import json
import math
import re
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import chat, evals, feeds, index, memory, retrieval, staging
from tessel.sources import files
from tessel.streaming.sync import ReasoningSplitter, new_entries, split_replies, sync_messages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# ---- retrieval


def bm25(texts, query, k1=1.5, b=0.75):
    docs = {k: re.findall("[a-z0-9]+", t.lower()) for k, t in texts.items()}
    avg = sum(map(len, docs.values())) / len(docs) or 1.0
    out = {}
    for term in set(re.findall("[a-z0-9]+", query.lower())):
        df = sum(term in d for d in docs.values())
        for k, d in docs.items():
            if tf := d.count(term):
                out[k] = out.get(k, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
    return out


def corpus(spark, texts):
    return spark.createDataFrame([(k, v) for k, v in texts.items()], "id string, content string")


def test_bm25_equals_plain(spark):
    texts = {"a": "the cat sat", "b": "the dog, the dog!", "c": "", "d": "cat's cat 9", "e": "bird"}
    for q in ("cat the", "the the dog's", "nothing"):
        found = {r.id: r.score for r in retrieval.bm25(corpus(spark, texts), [q], 10).collect()}
        want = bm25(texts, q)
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_search_edges(spark):
    rows = corpus(spark, {"a": "x y", "b": "y"})
    assert retrieval.bm25(rows, ["", "  "], 3).count() == 0
    assert retrieval.retrieve(rows, "other", ["x"]).count() == 0
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", []), ("d", [0.0, 0.0]), ("e", [1.0])], "id string, embedding array<float>")
    found = {r.id: r.score for r in retrieval.vector_search(vec, [[2.0, 0.0]], 9).collect()}
    assert found == {"a": 1.0, "d": -1.0, "e": -1.0}


def test_fusion_gives_every_corpus_a_seat(spark):
    a = spark.createDataFrame([("a1", 9.0), ("a2", 8.0)], "id string, score double")
    b = spark.createDataFrame([("b1", 0.1)], "id string, score double")
    assert [r.id for r in retrieval.fuse([a, b, b.where("false")], 2).collect()] == ["a1", "b1"]
    assert [retrieval.budget(6, n) for n in (1, 2, 9)] == [6, 8, 18]


def test_provenance_keeps_colons(spark):
    r = retrieval.describe(spark.createDataFrame([("library:l1:a:b:c:7",)], "id string")).first()
    assert (r.kind, r.source, r.item, r.place) == ("library", "l1", "a:b:c", 7)


def test_weights_never_lift_negative_scores(spark):
    rows = spark.createDataFrame([(-0.5, '{"weight": 10}'), (0.5, '{"weight": 10}'), (0.5, "bad"), (0.5, None)], "score double, meta string")
    assert [round(r.score, 4) for r in retrieval.weighted(rows).collect()] == [0.0, 0.675, 0.5, 0.5]


# ---- index


def items(spark, texts):
    return spark.createDataFrame([("library", "l", k, v, "{}") for k, v in texts.items()], "source_type string, source_id string, item_id string, content string, meta string")


def embedder(asked):
    def embed(missing):
        asked.append(missing.count())
        return missing.select("embed_hash", F.array(F.lit(1.0).cast("float")).alias("embedding"))

    return embed


def test_compile_reuses_edits_and_prunes(spark, tmp_path):
    store, asked = index.ChunkStore(spark, str(tmp_path / "store")), []
    long = " ".join(f"w{k}" for k in range(1200))
    first = items(spark, {"a": long, "b": "short text", "c": ""})
    chunks = index.with_vectors(index.chunk_items(first), index.chunk_items(first.limit(0)).withColumns({"embedding": F.lit(None).cast("array<float>"), "model": F.lit("m")}), embedder(asked), "m")
    store.write(chunks.drop("reused"))
    assert asked == [4] and store.read().count() == 4
    sig = index.signature("m")
    listed = index.manifest(first, index.completeness(store.read()), sig)
    own = first.where("item_id <> 'c'")
    assert {r.state for r in index.state(own, listed, sig, store.read()).collect()} == {"compiled"}
    assert {(r.state, r.resigned) for r in index.state(own, listed, index.signature("other")).collect()} == {("stale", 2)}
    assert {r.state for r in index.state(own, listed, index.signature("m", 100)).collect()} == {"stale"}
    assert {r.state for r in index.state(own, listed, sig, store.read().limit(0)).collect()} == {"stale"}
    edited = items(spark, {"a": long.replace("w1100 ", "new "), "d": "short text"})
    after, now = index.compile_items(edited, store.read(), listed, embedder(asked), "m")
    assert asked == [4, 1]  # one window changed; d has the words of b
    store.write(after.drop("reused"))
    assert {r.item_id for r in store.read().select("item_id").distinct().collect()} == {"a", "d"} and store.version() == 2
    assert {(r.item_id, r.signature) for r in now.collect()} == {("a", sig), ("d", sig)} and asked == [4, 1]  # nor did the manifest ask again
    again, _ = index.compile_items(edited, store.read(), now, embedder(asked), "m")
    assert again.count() == store.read().count() and asked == [4, 1, 0]
    other, _ = index.compile_items(edited, store.read(), now, embedder(asked), "n")
    assert asked[-1] == 4 and {r.model for r in other.select("model").distinct().collect()} == {"n"}  # another model: everything anew


def test_a_model_that_fails_now_and_then_leaves_one_truth(spark, tmp_path):
    own = items(spark, {k: f"text of {k}" for k in "abcdefgh"})
    empty = index.chunk_items(own.limit(0)).withColumns({"embedding": F.lit(None).cast("array<float>"), "model": F.lit("m")})
    none = own.limit(0).select("source_type", "source_id", "item_id", F.lit("").alias("fingerprint"), F.lit("").alias("signature"), F.lit(1).cast("long").alias("chunks"))
    flaky = lambda missing: missing.select("embed_hash", F.when(F.rand() < 0.5, F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    store, listed = index.compile_items(own, empty, none, flaky, "m")
    assert {r.item_id for r in store.where("embedding is not null").collect()} == {r.item_id for r in listed.collect()}


def test_a_store_writes_only_what_is_touched(spark, tmp_path):
    store = index.ChunkStore(spark, str(tmp_path / "s"), buckets=8)
    rows = spark.range(200).select(F.lit("t").alias("source_type"), (F.col("id") % 20).cast("string").alias("source_id"), F.col("id").alias("v"))
    store.write(rows)
    scope = spark.createDataFrame([("t", "3"), ("t", "77")], "source_type string, source_id string")
    before = store._folders(1)
    store.replace(scope, scope.where("source_id = '77'").withColumn("v", F.lit(-1).cast("long")))
    after = store._folders(2)
    assert 5 <= sum(before.get(k) == after.get(k) for k in range(8)) < 8
    got = {(r.source_id, r.v) for r in store.read().collect()}
    assert got == {(str(k % 20), k) for k in range(200) if k % 20 != 3} | {("77", -1)}
    with pytest.raises(Exception, match="exist"):
        store._commit(2, {})  # another writer was faster
    assert {(r.source_id, r.source, r["copy"]) for r in index.verified_copy(rows, store.read()).where("not ok").collect()} == {("3", 10, 0), ("77", 0, 1)}


def test_prune_with_an_empty_list_clears_the_scope(spark):
    rows = index.chunk_items(items(spark, {"a": "x", "b": "y"})).unionByName(index.chunk_items(items(spark, {"z": "q"}).withColumn("source_id", F.lit("other"))))
    left = index.prune(rows, "library", "l", rows.limit(0).select("item_id"))
    assert [r.item_id for r in left.collect()] == ["z"]


# ---- text


@pytest.mark.parametrize("n,size,overlap", [(0, 5, 2), (5, 5, 2), (6, 5, 2), (23, 5, 4), (23, 5, 9), (400, 200, 40)])
def test_windows_equal_plain(spark, n, size, overlap):
    words = [f"w{k}" for k in range(n)]
    over, at, want = min(overlap, size - 1), 0, []
    while words:
        want.append(" ".join(words[at : at + size]))
        if at + size >= n:
            break
        at += size - over
    assert one(spark, T.word_windows(F.lit("  " + " \n".join(words)), size, overlap)) == want


def test_templates_fill_once(spark):
    assert one(spark, T.fill(F.lit("{a} {b} {c} {"), {"a": F.lit("{b}"), "b": F.lit(None)})) == "{b}  {c} {"
    assert one(spark, T.render(F.lit("T {{ Title }}"), {"title": F.lit("$1 {{content}}"), "content": F.lit("body")})) == "T $1 {{content}}\n\nbody"


def test_cleaners(spark):
    assert one(spark, T.strip_reasoning(F.lit("<THINK>a\nb</think> yes <reasoning>tail"))) == "yes"
    assert one(spark, T.clean_transcript(F.lit("♪ [x] Hi.You (Music) there"))) == "Hi. You there"
    assert one(spark, T.defang(F.lit("== a ==\nb = c"))) == "-- a --\nb = c"
    assert one(spark, T.fold(F.lit("Straße & Co."))) == "strasse and co"
    assert one(spark, T.strip_markdown(F.lit("# H\n**b** [l](u) ![a](v)\n- x"))) == "H\nb l !a\nx"
    assert one(spark, T.page_title(F.lit("<TITLE>A &amp; B\n</title>"))) == "A & B" and one(spark, T.page_title(F.lit("x"), F.lit("url"))) == "url"
    assert one(spark, T.split_text(F.lit("a(b a(b c"), "(b", True)) == ["a", "a", "c"]  # not a pattern: taken as it is


@pytest.mark.parametrize("url,want", [("https://youtu.be/abcdefghijk?t=1", "abcdefghijk"), ("http://m.youtube.com/watch?a=b&v=abc-_fghijk", "abc-_fghijk"), ("https://example.com/watch?v=abcdefghijk", None), ("youtube.com/shorts/abcdefghijkl", None)])
def test_video_ids(spark, url, want):
    assert one(spark, T.video_id(F.lit(url))) == want


def test_media_types(spark):
    for raw, want in ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"RIFF0000WEBPxx", "image/webp"), (b"\xff\xd8\xff", "image/jpeg"), (b"", "")):
        assert one(spark, T.media_type(F.lit(raw))) == want


# ---- evaluation


@pytest.mark.parametrize("reply,want", [('{"a": 1}', {"a": 1}), ('x ```json\n{"a": 2}\n``` y', {"a": 2}), ('say {bad} then {"a": "}"} end', {"a": "}"}), ("[1]", {}), ("", {}), (None, {})])
def test_replies(reply, want):
    assert evals.parse_reply(reply) == want


def test_grades_clamp_and_missing_is_not_zero(spark):
    replies = spark.createDataFrame([("m", 1, '{"Tone": {"score": "12 of 10", "reasoning": "r"}, "why": "because 7"}'), ("m", 2, "none"), ("m", 3, '{"tone": true}')], "model string, row long, reply string")
    criteria = spark.createDataFrame([("tone", "score", "1", "10"), ("why", "reasoning", None, None)], "label string, mode string, min string, max string")
    grades = evals.normalise_grades(replies, criteria)
    assert [(r.label, r["avg"], r.percent, r.n) for r in evals.breakdown(grades).collect()] == [("tone", 10.0, 100.0, 1)]
    assert [(r.overall, r.graded, r.total) for r in evals.aggregate(grades).collect()] == [(100.0, 1, 3)]


def test_evaluation_end_to_end(spark):
    rows = spark.createDataFrame([(1, "cats"), (2, "dogs")], "row long, topic string")
    criteria = spark.createDataFrame([("len", "score", "0", "100")], "label string, mode string, min string, max string")
    grade = lambda ps: [json.dumps({"len": len(p)}) for p in ps]
    out = evals.evaluate(rows, "on {topic}", ["topic"], criteria, ["x", "y"], lambda ps: [p.upper() for p in ps], grade)
    assert sorted((r.model, r.row, r.score) for r in out.collect()) == [("x", 1, 16.0), ("x", 2, 16.0), ("y", 1, 16.0), ("y", 2, 16.0)]


# ---- memory


def test_merge_keeps_the_first_and_the_highest(spark):
    e = [("c", "1", "facts", "a", 3, False, "model", "1"), ("c", "2", "facts", "b", 9, False, "model", "2"), ("c", "3", "facts", "p", 5, True, "model", "3"), ("c", "4", "facts", "u", 5, False, "user", "4")]
    o = [("c", 1, "merge", None, ["1", "2", "3", "1"], "ab", None, None), ("c", 2, "delete", "3", [], None, None, None), ("c", 3, "update", "4", [], "no", None, None), ("c", 4, "add", None, [], " new ", "odd", 77), ("c", 5, "merge", None, ["1"], "x", None, None)]
    entries = spark.createDataFrame(e, memory.ENTRY)
    ops = spark.createDataFrame(o, "core string, seq long, op string, id string, ids array<string>, text string, category string, importance int")
    got = {r.id: (r.text, r.importance, r.category) for r in memory.apply_operations(entries, ops).collect()}
    assert got == {"1": ("ab", 9, "facts"), "3": ("p", 5, "facts"), "4": ("no", 5, "facts"), "c-4": ("new", 10, "other")}


def test_operations_against_a_fold_in_order(spark):
    """Random operations on two cores, merges of merges included, against one pass in order of seq."""
    import random

    r = random.Random(7)
    e = [("c", str(k), "facts", f"t{k}", k % 10 + 1, k % 7 == 0, "user" if k % 11 == 0 else "model", f"{k:03d}") for k in range(60)] + [("d", "1", "facts", "x", 5, False, "model", "1")]
    ops, known = [], [str(k) for k in range(60)]
    for seq in range(120):
        kind = r.choice(["add", "update", "delete", "merge", "merge"])
        ids = r.sample(known, r.randrange(1, 4)) if kind == "merge" else []
        ops.append(("c", seq, kind, r.choice(known) if kind in ("update", "delete") else None, ids, r.choice([f"n{seq}", f"n{seq}", " "]), r.choice(["goals", None, "odd"]), r.choice([None, 0, 8, 99])))
        known += [f"c-{seq}"] if kind == "add" else []
    left = {x[1]: dict(zip("core id category text importance pinned origin created".split(), x)) for x in e if x[0] == "c"}
    cat, clamp = lambda x: x if x in memory.CATEGORIES else "other", lambda x, d: d if x is None else max(1, min(10, x))
    safe = lambda x: x["pinned"] or x["origin"] == "user"
    for _, seq, op, i, ids, text, category, importance in ops:
        text = text.strip()
        if op == "add" and text:
            left[f"c-{seq}"] = {"id": f"c-{seq}", "text": text, "importance": clamp(importance, 5), "category": cat(category), "pinned": False, "origin": "ai"}
        elif op == "update" and i in left and text:
            left[i] |= {"text": text, "importance": clamp(importance, left[i]["importance"])} | ({"category": cat(category)} if category else {})
        elif op == "delete" and i in left and not safe(left[i]):
            del left[i]
        elif op == "merge" and text:
            own = [x for x in dict.fromkeys(ids) if x in left and not safe(left[x])]
            if len(own) > 1:
                left[own[0]] |= {"text": text, "category": cat(category or left[own[0]]["category"]), "importance": clamp(importance, max(left[x]["importance"] for x in own))}
                for x in own[1:]:
                    del left[x]
    got = memory.apply_operations(spark.createDataFrame(e, memory.ENTRY), spark.createDataFrame(ops, "core string, seq long, op string, id string, ids array<string>, text string, category string, importance int")).collect()
    assert {x.id: (x.text, x.importance, x.category, x.pinned) for x in got if x.core == "c"} == {k: (v["text"], v["importance"], v["category"], v["pinned"]) for k, v in left.items()}
    assert [x.id for x in got if x.core == "d"] == ["1"] and len(got) == len(left) + 1


# ---- staging


@pytest.fixture
def people(spark):
    df = spark.createDataFrame([(k, f"n{k}", None if k % 2 else "x") for k in range(20)], "id int, name string, note string")
    return staging.stage(df, ["id"])


def test_first_original_stays_and_last_edit_wins(spark, people):
    edits = spark.createDataFrame([(3, "name", "a", 1), (3, "name", "b", 2), (4, "note", None, 1)], "rowid long, col string, value string, seq int")
    once, old = staging.edit(people, edits)
    twice, old = staging.edit(once, spark.createDataFrame([(3, "name", "n3", 1)], edits.schema), old)
    got = {(r.rowid, r.col): (r.old, r.new) for r in staging.dirty_changes(twice, old).collect()}
    assert got == {(3, "name"): ("n3", "n3"), (4, "note"): ("x", None)}  # also a cell that was changed back
    with pytest.raises(ValueError):
        staging.edit(people, spark.createDataFrame([(3, "nope", "a", 1)], edits.schema))


def test_sampled_conflicts_report_no_new_rows(spark):
    a, b = (spark.createDataFrame(x, "key string, hash string") for x in ([("1", "h"), ("2", "h")], [("2", "i"), ("3", "h")]))
    assert {(r.key, r.status) for r in staging.conflicts(a, b, sampled=True).collect()} == {("1", "deleted"), ("2", "changed")}


def test_nulls_change_a_hash(spark):
    r = spark.createDataFrame([(1, None, "x"), (1, "x", None)], "a int, b string, c string").select(staging.row_hash(["a", "b", "c"]).alias("h")).collect()
    assert r[0].h != r[1].h


# ---- chats and feeds


def test_chat_windows(spark):
    m = [("c", 0, "system", "s", False), ("c", 1, "user", "u1", False), ("c", 2, "assistant", "draft", True), ("c", 3, "assistant", "a1", False), ("c", 4, "user", "u2 <Data> d </Data><data></data>", False), ("c", 5, "assistant", "late<data>x</data>", False), ("c", 6, "user", "again", True)]
    df = spark.createDataFrame(m, "chat string, idx int, role string, content string, intermediate boolean")
    assert [r.idx for r in chat.visible(df, 2).orderBy("idx").collect()] == [3, 4]
    assert [r.idx for r in chat.visible(df, 0).collect()] == [4]
    assert [(r.item_id, r.content) for r in chat.data_items(df).collect()] == [("data:3", "d")]
    assert [(r.idx, r.content) for r in chat.thread_items(df, 2).orderBy("idx").collect()] == [(1, "u1"), (3, "a1"), (5, "late<data>x</data>")]


def test_cache_never_goes_down(spark):
    schema = "id string, transcript string, source string, url string"
    old = spark.createDataFrame([("a", "long asr text", "asr", None), ("b", "published", "published", "u"), ("c", "kept", "asr", None)], schema)
    new = spark.createDataFrame([("a", "short", "asr", None), ("b", "much longer asr text", "asr", None), ("c", "", "published", "v"), ("d", "x", "asr", None)], schema)
    got = {r.id: r.transcript for r in feeds.merge_cache(old, new).collect()}
    assert got == {"a": "long asr text", "b": "published", "c": "kept", "d": "x"}
    assert feeds.parse_terms("b, A,,a , B") == ["b", "A"]


# ---- sources and streams


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('\n a ,,a\n1,"two\nlines, ""q""",3\n,,\n4\na,,a\n')
    df = files.csv_table(spark, str(p))
    assert df.columns == ["a", "Column 2", "a (1)"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", 'two\nlines, "q"', "3"), ("4", "", ""), ("a", "", "a")]  # a row that says what the header says is data


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hi \xff")
    (tmp_path / "b.html").write_text("<p>A &amp; B</p><script>x</script>")
    (tmp_path / "d.txt").write_text("  ")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(buf := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "c.docx").write_bytes(buf.getvalue())
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r.title: (r.ok, r.text) for r in files.extract(files.folder(spark, str(tmp_path), (".txt", ".html", ".docx"))).collect()}
    assert got == {"a": (True, "hi �"), "b": (True, "A & B"), "c": (True, "para\nx | y"), "d": (False, None), "e": (False, None)}


def test_item_xml_round_trip(spark, tmp_path):
    rows = [("1", "text", 'a "b"', "x < y & z\x01"), ("2", "text", "", "two")]
    xml = files.items_xml(spark.createDataFrame(rows, "id string, type string, label string, content string"))
    (tmp_path / "x.xml").write_text("<library>" + "".join(r.xml for r in xml.collect()) + "</library>")
    assert {r.id: (r.label, r.content) for r in files.read_items_xml(spark, str(tmp_path / "x.xml")).collect()} == {"1": ('a "b"', "x < y & z"), "2": ("", "two")}


def test_types():
    assert [files.spark_type(*a) for a in (("NUMERIC", 9, 2), ("TINYINT",), ("JSONB",), ("odd",))] == ["decimal(9,2)", "int", "variant", "string"]


def test_splitter_holds_back_cut_tags():
    s, out = ReasoningSplitter(), []
    for p in ("a <th", "ink>b</", "think>c <", "d"):
        out += s.feed(p)
    out += s.feed("", last=True)
    assert "".join(t for k, t in out if k == "answer") == "a c <d" and "".join(t for k, t in out if k == "reasoning") == "b"


def test_streamed_chats_are_indexed_whole(spark, tmp_path):
    """Three batches: a question is indexed once another one follows, answers and edits are, what was taken back is not."""
    schema = "chat string, idx int, role string, content string, intermediate boolean, removed boolean"
    say = lambda k: f"message {k} that is long enough to be searched by its words"
    batches = [
        [("c", 0, "user", say(0), False, False), ("d", 0, "user", say(9), False, False)],
        [("c", 1, "assistant", say(1), False, False), ("c", 2, "user", say(2), False, False)],
        [("c", 3, "assistant", say(3), False, False), ("c", 1, "assistant", say(1) + " edited", False, False), ("c", 4, "user", "q", False, False), ("c", 5, "user", say(5), True, False), ("d", 1, "user", say(8), False, False)],
        [("c", 3, "assistant", None, False, True), ("d", 1, "user", None, None, True)],
    ]
    log, store, asked = index.ChunkStore(spark, str(tmp_path / "log"), scope=("chat",)), index.ChunkStore(spark, str(tmp_path / "store")), []
    seen = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sync_messages(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), log, store, embedder(asked), "m", str(tmp_path / "check")).awaitTermination()
        seen.append({r.id: r.content for r in store.read().collect()} if store.read() is not None else {})
    ids = lambda x: {k.split(":", 1)[1][:-2] for k in x}
    assert [ids(x) for x in seen] == [set(), {"c:m0", "c:m1"}, {"c:m0", "c:m1", "c:m2", "c:m3", "d:m0"}, {"c:m0", "c:m1", "c:m2"}]
    assert seen[2]["chat_thread:c:m1:0"].endswith("edited") and sum(asked) == 6
    last = spark.createDataFrame(batches[3], schema)
    last.write.parquet(str(tmp_path / "again"))
    sync_messages(spark.readStream.schema(schema).parquet(str(tmp_path / "again")), log, store, embedder(asked), "m", str(tmp_path / "check2")).awaitTermination()
    assert {r.id: r.content for r in store.read().collect()} == seen[3] and asked[-1] == 0  # replayed: nothing changes


def test_replies_are_parted_over_batches(spark, tmp_path):
    schema = "run string, seq long, piece string, last boolean"
    batches = [[("a", 0, "x <th", False), ("b", 0, "<reasoning>why", False)], [("a", 1, "ink>y</", False), ("a", 2, "think>z <", False)], [("a", 3, "d", True), ("b", 1, " so</reasoning> end", True)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        parts = split_replies(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        parts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("run", "seq").collect()
    text = lambda run, kind: "".join(r.text for r in rows if (r.run, r.kind) == (run, kind))
    assert [text("a", "answer"), text("a", "reasoning"), text("b", "answer"), text("b", "reasoning")] == ["x z <d", "y", " end", "why so"]


def test_stream_of_entries_has_each_once(spark, tmp_path):
    spark.createDataFrame([("e1",), ("e1",), ("e2",)], "id string").write.parquet(str(tmp_path / "in"))
    new_entries(spark.readStream.schema("id string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("entries").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("entries").count() == 2


def test_keys_are_counted_in_tasks_that_follow_their_number(spark, monkeypatch, tmp_path):
    """Keys of any number are counted KEYS at a time; before, Spark put all that packed well into one task."""
    from pyspark.sql import functions as F

    from tessel.operators import retrieval

    parts, keep = [], retrieval.saved

    def seen(df, folder, name):
        if name == "again":
            parts.append(df.rdd.getNumPartitions())
        return keep(df, folder, name)

    monkeypatch.setattr(retrieval, "KEYS", 10)
    monkeypatch.setattr(retrieval, "saved", seen)
    rows = spark.range(95).select(F.concat(F.lit("k"), F.col("id") % 90).alias("id"), F.lit("b c").alias("content"))
    found = retrieval.bm25(rows, ["c"], 3).collect()
    assert parts == [10] and [r.id for r in found] == ["k0", "k1", "k2"] and found[0].score > found[2].score / 2


def test_found_rows_go_to_the_chunks(spark):
    """The chunks of a search are not shuffled to be joined with the few rows that it found."""
    from tessel.operators import answers

    chunks = spark.createDataFrame([(f"c{k}", "s", f"word{k % 3} x{k}") for k in range(30)], "id string, source_id string, content string")
    asked = spark.createDataFrame([(1, "word1", ["s"])], "query int, q string, library_ids array<string>")
    found = answers.retrieve_for(asked, chunks, spark.createDataFrame([("s", "compiled")], "source_id string, state string"), 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and found.count() == 4


def test_pairs_of_postings_and_queries_are_no_rows(spark, tmp_path):
    """A term that all rows and all queries have is scored without a row for each pair; results are those of a scan."""
    from pyspark.sql import functions as F

    from tessel.operators import postings, retrieval

    rows = spark.range(300).select(F.concat(F.lit("k"), F.col("id") % 290).alias("id"), F.concat(F.lit("the "), F.repeat(F.lit("cat "), (F.col("id") % 5).cast("int")), F.col("id") % 7).alias("content"))
    asked = spark.range(200).select(F.col("id").alias("query"), F.concat(F.lit("The cat "), F.col("id") % 9).alias("q"))
    postings.write(*postings.build(rows), str(tmp_path))
    found = postings.search(*postings.read(spark, str(tmp_path)), asked, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    plain = lambda df: sorted((r["query"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert plain(found) == plain(retrieval.bm25(rows, asked, 4)) and found.count() == 800
