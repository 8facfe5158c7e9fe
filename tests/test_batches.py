import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessel.operators import batch, evals, lookups, personas, research, staging
from tests.test_operators import people  # noqa: F401


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names_of_files(spark):
    odd = [('a<b>:"/\\|?*\x01c', "a b c"), ("  .hidden. ", "hidden"), ("", "untitled"), (None, "untitled"), ("CON", "CON_"), ("com9", "com9_"), ("x" * 130, "x" * 120), (" . ", "untitled"), ("y" * 119 + " z", "y" * 119)]
    got = spark.createDataFrame(odd, "n string, w string").select("w", batch.file_stem("n").alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_paths_are_unique_and_never_the_source(spark):
    rows = [(1, "t", None, None), (2, "t", None, None), (3, "t (2)", None, None), (4, "t", None, None), (5, None, None, None), (6, "z", "/in/a.md", "Chosen"), (7, "z", "/in/a.b.txt", " "), (8, "taken", None, None)]
    items = spark.createDataFrame(rows, "pos long, title string, source_path string, chosen_title string")
    taken = spark.createDataFrame([("/o/taken.md",), ("/o/taken (2).md",), ("/o/free.txt",)], "path string")
    got = {r.pos: r.path for r in batch.output_paths(items, output_dir="/o", by_title=True, taken=taken).collect()}
    assert len(set(got.values())) == 8 and got[1] == "/o/t.md" and got[3] == "/o/t (2).md" and {got[2], got[4]} == {"/o/t (3).md", "/o/t (4).md"}
    assert (got[5], got[6], got[7], got[8]) == ("/o/untitled.md", "/o/Chosen.md", "/o/a.b.md", "/o/taken (3).md")
    beside = {r.pos: (r.path, r.error) for r in batch.output_paths(items, "beside_source", suffix="-x").collect()}
    assert beside[6] == ("/in/a-x.md", None) and beside[1] == (None, "has no file on disk")
    assert {r.error for r in batch.output_paths(items.where("pos = 6"), "beside_source").collect()} == {"needs a name prefix or suffix"}
    assert {r.error for r in batch.output_paths(items).collect()} == {"no output folder"}


def test_files_and_combined_files(spark, tmp_path):
    files = spark.createDataFrame([(f"{tmp_path}/a/b.md", "é\n"), (f"{tmp_path}/c.md", ""), ("/proc/none/x", "q")], "path string, data string")
    got = {r.path: r.ok for r in batch.write_files(files).collect()}
    assert list(got.values()) == [True, True, False] and (tmp_path / "a/b.md").read_text() == "é\n"
    said = one(spark, batch.body(F.lit("T"), F.lit(None).cast("string"), F.lit("c"), F.lit("p"), F.lit("**b**"), True, False, True))
    assert said == "# Source: T\n\nc\n\n---\n\n# Response\n\nb" and one(spark, batch.body(*[F.lit("x")] * 4, F.lit(None).cast("string"))) == ""
    parts = batch.combined(spark.createDataFrame([(k, f"t{k}" if k else None, f"b{k}\n") for k in range(40)], "pos long, title string, body string").repartition(5))
    batch.write_combined(parts, str(tmp_path / "all"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "all").glob("part-*")))
    assert whole == "".join(f"# {f't{k}' if k else 'Untitled'}\n\nb{k}\n\n\n---\n\n" for k in range(40))
    assert batch.count_audit(spark, str(tmp_path / "all")) > 0


def test_projects_that_would_fail(spark):
    schema = "project int, model string, sources array<struct<kind:string,value:string>>, files boolean, export_mode string, name_prefix string, name_suffix string, output_dir string"
    rows = [(1, "m", [("rss", "u")], True, "per_item", None, None, "/o"), (2, " ", [], False, None, None, None, None), (3, "m", [("folder", " "), ("odd", "x")], True, "beside_source", "", None, None), (4, "m", [("rss", "u")], True, "beside_source", "p", None, None), (5, "m", [("search", "q")], True, None, None, None, "")]
    got = {}
    for r in batch.problems(spark.createDataFrame(rows, schema)).orderBy("project", "pos").collect():
        got.setdefault(r.project, []).append(r.problem.split(":")[0].split(" needs")[0])
    assert got == {2: ["No model selected.", "Add at least one input source."], 3: ["Source 1", "Source 2", "Saving next to the original files"], 4: ["Saving next to the original files only works for folder sources."], 5: ["Choose an output folder for the exported files."]}


def test_research(spark):
    good = "<p>" + "Plain words of a page that can be read. " * 30 + "</p>"
    raw = spark.createDataFrame([(1, 0, "http://a.org/1", "<b>A</b>", "d &amp; e", ["s1"]), (1, 1, "ftp://x", "", "", None), (1, 2, "http://a.org/1", "again", "", None), (1, 3, "http://b.org/", " ", None, [None, "<i>snip</i>"]), (1, 4, "http://a.org/2", "C", "", None), (2, 0, "http://c.org", "D", "", [])], "query int, pos int, url string, title string, description string, snippets array<string>")
    found = research.results(raw)
    assert [(r["query"], r["rank"], r.url, r.title, r.description, r.snippets) for r in found.orderBy("query", "rank").collect()] == [(1, 0, "http://a.org/1", "A", "d & e", ["s1"]), (1, 1, "http://b.org/", "http://b.org/", "", ["snip"]), (1, 2, "http://a.org/2", "C", "", []), (2, 0, "http://c.org", "D", "", [])]
    assert research.results(raw, domains=["a.org"]).count() == 2 and research.results(raw, limit=1).count() == 2
    pages = spark.createDataFrame([("http://a.org/1", "<p>Please log in to continue</p>"), ("http://b.org/", good), ("http://a.org/2", good)], "url string, html string")
    rows = research.crawled(found, pages, 1)
    assert [(r.url, r.page) for r in rows.orderBy("query", "rank").collect()] == [("http://a.org/1", None), ("http://b.org/", 1), ("http://a.org/2", None), ("http://c.org", None)]
    got = {r["query"]: r.block for r in research.research_block(rows, 2).collect()}
    assert got[1].startswith("===== PAGE 1 =====\nTITLE: http://b.org/\nURL: http://b.org/\n\nPlain words") and "only 1 of the target 2 pages" in got[1] and got[1].endswith("- A — http://a.org/1\n  d & e\n- C — http://a.org/2\n  ")
    assert "only 0 of the target 2" in got[2] and got[2].endswith("- D — http://c.org\n  ")


DEFINED = """<persona version="1"><profile><name>Ann &amp; Co</name><bio> b
x </bio></profile><speaking><tone>dry</tone><variant name="v &quot;1&quot;">d</variant><variant name="w"/><example><user>u</user><reply>r &lt; s</reply></example></speaking>
<models><chat_model>m</chat_model><temperature>x</temperature></models><stores retrieval="odd" prompt_reword="False"/>
<pipeline><step id="s1" type="llm" use_history="TRUE"><prompt>p</prompt><schema>{"a": [1]}</schema></step><step id="s2" type="memory_retrieval" model="n"/></pipeline></persona>"""


def test_personas_go_round(spark):
    bad = {"x": "no xml", "v": '<persona version="2"><profile><name>n</name></profile></persona>', "n": '<persona version="1"><profile><name> </name></profile></persona>', "s": '<persona version="1"><profile><name>n</name></profile><pipeline><step type="odd"/></pipeline></persona>', "p": '<persona version="1"><profile><name>n</name></profile><stores knowledge="../up"/></persona>', "j": '<persona version="1"><profile><name>n</name></profile><pipeline><step><schema>{bad</schema></step></pipeline></persona>', "r": "<other/>"}
    df = spark.createDataFrame([("ann", DEFINED), *bad.items()], "id string, xml string")
    rows = {r.id: r for r in personas.read_definitions(df).collect()}
    assert {k for k, r in rows.items() if r.error} == set(bad) and all(rows[k].name == k and rows[k].persona is None for k in bad)
    p = rows["ann"].persona
    assert (p.name, p.bio, p.tone, [tuple(v) for v in p.variants], [tuple(e) for e in p.examples]) == ("Ann & Co", " b\nx ", "dry", [('v "1"', "d"), ("w", "")], [("u", "r < s")])
    assert (p.chat_model, p.embedding_model, p.temperature, p.retrieval, p.prompt_reword, p.knowledge) == ("m", "nomic-embed-text", 0.7, "hybrid", False, "knowledge/")
    assert [(s.id, s.type, s.model, s.use_history, s.prompt, s.schema) for s in p.pipeline] == [("s1", "llm", "", True, "p", '{"a": [1]}'), ("s2", "memory_retrieval", "n", False, "", None)]
    again = personas.read_definitions(personas.read_definitions(df).where("error is null").select("id", personas.definition("persona").alias("xml"))).first()
    assert again.error is None and again.persona == p


def test_fresh_ids(spark):
    known = spark.createDataFrame([("ann",), ("ann-2",), ("bob-3",)], "id string")
    new = spark.createDataFrame([(0, "Ann"), (1, "ANN!"), (2, "Bob"), (3, "bob"), (4, "??"), (5, "New One"), (6, "new one")], "pos int, name string")
    got = {r.pos: r.id for r in personas.fresh_ids(new, known).collect()}
    assert got == {0: "ann-3", 1: "ann-4", 2: "bob", 3: "bob-4", 4: "persona", 5: "new-one", 6: "new-one-2"}


def test_bundles(spark):
    def archive(members):
        with zipfile.ZipFile(b := io.BytesIO(), "w") as z:
            for k, v in members.items():
                z.writestr(k, v)
        return bytearray(b.getvalue())

    files = [("good", archive({"persona.xml": "x", "sources/a.txt": "s", "sources/": "", "memories/entries/1.json": "{}"})), ("bad", archive({"persona.xml": "x", "sources/../../up": "y"})), ("odd", archive({"other/x": "y"})), ("none", bytearray(b"zzz"))]
    got = {}
    for r in personas.bundle_members(spark.createDataFrame(files, "path string, content binary")).collect():
        got.setdefault(r.path, []).append((r.member, bytes(r.data) if r.data is not None else None, r.error is None))
    assert sorted(got["good"]) == [("memories/entries/1.json", b"{}", True), ("persona.xml", b"x", True), ("sources/a.txt", b"s", True)]
    assert got["bad"] == [("sources/../../up", None, False)] and got["odd"] == [("other/x", None, False)] and got["none"] == [(None, None, False)]
    members = spark.createDataFrame([("p", "persona.xml", bytearray(b"1")), ("p", "sources/b", bytearray(b"2")), ("p", "/abs", bytearray(b"3"))], "path string, member string, data binary")
    with zipfile.ZipFile(io.BytesIO(bytes(personas.bundles(members).first().content))) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"persona.xml": b"1", "sources/b": b"2"}
    own = personas.memory_items(spark.createDataFrame([("p", "1", "t", "d"), ("p", "2", None, " ")], "persona string, id string, title string, description string")).collect()
    assert [(r.item_id, r.content, json.loads(r.meta)) for r in own] == [("1", "t\nd", {"label": "t"})]


def test_trees(spark):
    p = [("system", "g", "c", "a"), ("system", "g", "c", "b"), ("system", "g", "d", "a"), ("pre", "g", "c", "a"), ("system", "h", "c", "a")]
    tree = spark.createDataFrame(p, "kind string, group string, category string, name string")
    sizes = [personas.slice_tree(tree, *a).count() for a in (("system", "g"), ("odd", "g", "c"), ("system", "g", "c", "b"), ("pre", "g"), ("system", "x"), ("system", "g", None, "a"))]
    assert sizes == [3, 2, 1, 1, 0, 3]
    chats = spark.createDataFrame([(1, " hi ", True, None, None, None), (2, "hi", False, None, None, None), (3, None, None, "s", None, None), (4, "x", True, "", True, False)], "chat int, pre_prompt string, pre_as_system boolean, system_prompt string, system_on boolean, pre_on boolean")
    got = {r.chat: (r.system_prompt, r.system_on, r.pre_prompt, r.pre_on, r.changed) for r in personas.migrated_prompts(chats).collect()}
    assert got == {1: (" hi ", True, "", False, True), 2: ("", False, "hi", True, True), 3: ("s", True, "", False, True), 4: ("", True, "x", False, False)}


def test_columns_are_filled_in_order(spark, people):  # noqa: F811
    asked = spark.sparkContext.accumulator(0)

    def generate(prompts):
        asked.add(len(prompts))
        if "n3" in prompts[0]:
            raise ValueError("no")
        return [f" <{p}> " for p in prompts]

    search = lambda qs: [q * 3000 for q in qs]
    columns = [{"name": "one", "kind": "prompt", "template": "a {name}"}, {"name": "two", "kind": "prompt", "template": "b {one}{note}"}, {"name": "web", "kind": "search", "template": " {note} "}]
    got = {(r.rowid, r.col): (r.value, r.error is None) for r in staging.process(people.where("id < 5"), columns, generate, search).collect()}
    assert got[2, "two"] == ("<b <a n2>x>", True) and got[3, "one"] == (None, False) and got[3, "two"] == ("<b >", True)
    assert got[2, "web"] == ("x" * 3000, True) and got[1, "web"] == ("", True) and len(got) == 15 and asked.value == 10
    assert all(not r[1] for k, r in {(r.rowid, r.col): (r.value, r.error is None) for r in staging.process(people.where("id = 2"), columns[2:], generate).collect()}.items())


def test_plans_of_writing_back(spark, people):  # noqa: F811
    edits = spark.createDataFrame([(2, "name", "a", 1), (3, "name", "b", 1), (4, "name", "c", 1)], "rowid long, col string, value string, seq int")
    changes = staging.dirty_changes(*staging.edit(people, edits))
    found = spark.createDataFrame([('{"id":2}', "changed"), ('{"id":3}', "unchanged"), ('{"id":9}', "new")], "key string, status string")
    plan = lambda *a: sorted(r.key for r in staging.plan_write_back(changes, ["id", "name"], ["id"], *a).collect())
    assert plan(found, True, "skip") == ['{"id":3}', '{"id":4}'] and len(plan(found, True, "overwrite")) == 3 and len(plan(found.where("status <> 'changed'"), True)) == 3
    for wrong, args in ((PermissionError, (found, False)), (RuntimeError, (found, True))):
        with pytest.raises(wrong):
            plan(*args)
    with pytest.raises(ValueError):
        staging.plan_write_back(changes, ["name"], [], found, True)
    audit = spark.createDataFrame([('{"id":3}', "applied"), ('{"id":4}', "nomatch")], "key string, status string")
    assert [tuple(r) for r in staging.applied(changes, audit).collect()] == [(3, "name")]
    assert staging.add_column(staging.add_column(people, "x", "int"), "x").columns == [*people.columns, "x"]
    report = staging.dry_run_report(staging.dry_run(changes, "people", {}, ["name"]), changes, ["name"], 2).collect()
    assert [(r.rowid, r.total_rows, r.truncated) for r in report] == [(2, 3, True), (3, 3, True)]
    assert staging.count_rows(people, "random_n", 5).first().n == 5 and staging.count_rows(people, where="id > 17").first().n == 2


def test_generated_rows_and_rubrics(spark):
    own = {"a": "an animal ", "b": "", "c": "x", "out": "y"}
    assert evals.target_columns(["a", "b", "c", "out", "d"], own, " out ") == ["a", "c"]
    asked = [r.prompt for r in evals.generation_prompts(spark.createDataFrame([(0,), (1,)], "row int"), ["a", "b", "out"], own, "out", "s").orderBy("row").collect()]
    assert '- "a": an animal\n\nThis is test case #2 (variation token: s#1). Make it' in asked[1] and asked[0].endswith('Shape:\n{\n  "a": "<value>"\n}')
    rows = evals.generated_rows(spark.createDataFrame([(0, 'x {"a": " cat ", "c": [1, 2], "z": 1}'), (1, "none"), (2, '{"a": 3, "c": null}')], "row int, reply string"), ["a", "c"]).orderBy("row").collect()
    assert [(r.a, r.c) for r in rows] == [("cat", "[1, 2]"), ("", ""), ("3", "")]
    lines, shape = evals.rubric([{"label": " t ", "min": "0", "max": 2.5, "guidance": "g"}, {"label": "", "mode": "score"}, {"label": "b", "min": 5, "max": 1}, {"label": "w", "mode": "reasoning"}])
    assert lines == '- "t" (score 0-2.5): g\n- "b" (score 1-10): \n- "w" (reasoning only): ' and json.loads(shape)["t"] == {"score": "<number 0-2.5>", "reasoning": "<one sentence>"}


def test_memory_evaluation(spark):
    rows = spark.createDataFrame([(0, "said", [("1", "likes tea")]), (1, " ", []), (2, "more", [])], "row long, transcript string, entries array<struct<id:string,text:string>>")
    ops = spark.createDataFrame([(0, 1, "update", "1", [], "likes coffee", None, None), (0, 2, "add", None, [], "new", None, None)], "row long, seq long, op string, id string, ids array<string>, text string, category string, importance int")
    criteria = spark.createDataFrame([("fit", "score", "0", "10")], "label string, mode string, min string, max string")
    grade = lambda prompts: ['{"fit": 9}' if p == "said\n\nlikes coffee\nnew" else "no idea" for p in prompts]
    got = evals.memory_evaluation(rows, ops, grade, criteria)
    assert [(r.row, r.score) for r in got.collect()] == [(0, 9.0)] and [(r.graded, r.total) for r in evals.aggregate(got).collect()] == [(1, 1)]


def test_small_lookups(spark):
    items = lookups.with_ids(spark.createDataFrame([("x", "a"), ("", "b"), (None, "b")], "id string, k string"), ["k"]).collect()
    assert [r.filled for r in items] == [False, True, True] and items[1].id == items[2].id and len(items[1].id) == 12
    m = lookups.masked(spark.createDataFrame([("h", "pw", None), ("h", "", "k")], "host string, password string, key string"), ["password", "key", "gone"]).collect()
    assert [(r.has_password, r.has_key) for r in m] == [(True, False), (False, True)] and m[0].asDict().keys() == {"host", "has_password", "has_key"}
    assert [one(spark, lookups.search_scope(F.lit(s))) for s in (" Thread ", "x", None)] == ["thread", "attachments", "attachments"]
    assert [tuple(x) for x in one(spark, lookups.single_turn(F.lit("p")))] == [("user", "p")]
    e = spark.createDataFrame([(1, "b"), (1, None), (2, "b")], "v int, body string")
    assert lookups.cached(e, 1).count() == 1


def test_trees_are_written_in_pieces(spark, tmp_path):
    """No file holds more prompts than it may, each has its own root, and reading them gives the tree in its order."""
    rows = [(f"g{k % 3}" if k % 7 else None, f"c<{k % 2}", f"n{k}", f"p & {k}", 100 - k) for k in range(50)]
    df = spark.createDataFrame(rows, "group string, category string, name string, prompt string, pos long").repartition(3)
    for most in (4, 1000):
        path = str(tmp_path / str(most))
        personas.write_tree(df, "system", path, most)
        files = spark.read.text(path, wholetext=True).select("value").collect()
        assert len(files) == -(-50 // most) and all(f.value.count("<prompts ") == 1 and f.value.count("<prompt ") <= most for f in files)
        got = [(r.group, r.category, r["name"], r.prompt) for r in personas.read_tree(spark, path).orderBy("pos").collect()]
        order = lambda r: (min(x[4] for x in rows if x[0] == r[0]), min(x[4] for x in rows if x[:2] == r[:2]), r[4])
        assert got == [(g or "Imported Group", c, n, p) for g, c, n, p, _ in sorted(rows, key=order)]
