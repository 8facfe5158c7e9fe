import json

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import steps

RUNS = "run long, message string, history string"


def test_steps_share_a_context_and_pause(spark):
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(1)
        p = prompts[0]
        assert p.startswith("You are Ann.")
        if "analyse" in p:
            if "broken" in p:
                return ["no json"]
            if "slow" in p and "was invalid: missing required field 'knowledge_queries'" not in p:
                return ['{"other": 1}']
            return ['Sure {"knowledge_queries": ["cats", "dogs"], "mood": "good"}']
        if "boom" in p:
            raise ValueError("down")
        return [f" answer to {p.split('say: ')[1]} "]

    def search(questions):
        got = {r["query"]: r.q for r in questions.collect()}
        assert got.get(1) == "cats dogs"
        return questions.where("query <> 4").select("query", F.lit(0).alias("rank"), F.lit("i").alias("item_id"), F.lit("s").alias("source_id"), F.concat(F.lit("about "), "q").alias("content"))

    plan = [{"id": "analyse", "prompt": "analyse {message} as {\"a\": 1}", "schema": {"required": ["knowledge_queries"], "properties": {"knowledge_queries": {"type": "array"}}}, "use_history": True}, {"id": "k", "type": "knowledge"}, {"id": "reply", "prompt": "say: {message}|{knowledge}|{mood}|{none}"}]
    runs = spark.createDataFrame([(1, "hello", "User: x"), (2, "broken", None), (3, "slow", ""), (4, "boom", "")], RUNS)
    got = {r.run: r for r in steps.run_steps(runs, plan, model, {"knowledge": search}, "You are Ann.").collect()}
    assert got[1].context["final"] == "answer to hello|[1] (i) about cats dogs|good|{none}" and got[1].error is None and got[1].context["draft"] == got[1].context["reply"]
    assert (got[2].error, got[2].paused, set(got[2].context)) == ("response was not valid JSON", 0, {"message"})
    assert got[3].context["mood"] == "good" and got[3].error is None and json.loads(got[3].context["analyse"])["mood"] == "good"
    assert got[4].error == "ValueError: down" and got[4].paused == 2 and got[4].context["knowledge"] == "(none found)"
    assert asked.value == 1 + 3 + 2 + 1 + 3  # first step: once, thrice, twice, once; last: all but the paused one
    again = spark.createDataFrame([(4, "fine", "", {"knowledge": "kept"})], RUNS + ", context map<string,string>")
    assert steps.run_steps(again, plan, model, {"knowledge": search}, "You are Ann.", start=2).first().context["final"] == "answer to fine|kept|{mood}|{none}"


def test_rounds(spark):
    rows = spark.createDataFrame([(1, "a {{answer}}"), (2, "b")], "row int, prompt string")

    def model(prompts):
        if any(p == "R b -> [b]!" for p in prompts):
            raise ValueError
        return [f"[{p}]" if not p.startswith("R ") else p[-4:] for p in prompts]

    got = {(r.row, r.round): (r.answer, r.intermediate) for r in steps.refined(rows.repartition(2, "row"), model, "R {{prompt}} -> {{ answer }}!", 2).collect()}
    assert len(got) == 6 and got[2, 0] == ("[b]", True) and got[2, 2] == ("[b]", False) and got[1, 0][0] == "[a {{answer}}]" and got[1, 2][1] is False


def test_contexts_and_better_instructions(spark):
    chunks = spark.createDataFrame([("i", "one"), ("j", "two")], "item_id string, content string")
    items = spark.createDataFrame([("i", "w1 w2 w3"), ("j", "x")], "item_id string, content string")
    got = {r.item_id: r.context for r in steps.situated(chunks.repartition(2, "item_id"), items, lambda ps: [f" in {p.split()[1]} " if "Excerpt:\none" in p else None for p in ps], 2).collect()}
    assert got == {"i": "in w1", "j": ""}
    rows = spark.createDataFrame([(1, "do it", "h"), (2, " ", None), (3, "keep", None)], "row int, text string, history string")
    better = {r.row: r.better for r in steps.improved(rows, lambda ps: ["Instruction: Do it well" if "do it" in p and "reference only):\nh" in p else " " for p in ps]).collect()}
    assert better == {1: "Do it well", 2: " ", 3: "keep"}


def test_chunk_settings_and_payloads(spark):
    assert T.chunk_settings(10, -3) == (64, 0) and T.chunk_settings(0, None) == T.INDEXED and T.chunk_settings("200", "20") == (200, 20) and T.chunk_settings("x", "y") == T.INDEXED
    page = 'x var data = {"a": {"b": "}; {"}, "c": "\\"}"}; more var bad = {"a": ; "KEY":"val" "EMPTY":""'
    df = spark.createDataFrame([(page,), (None,)], "p string")
    got = df.select(T.assigned("p", "data").alias("a"), T.assigned("p", "bad").alias("b"), T.assigned("p", "none").alias("n"), T.quoted("p", "KEY").alias("k"), T.quoted("p", "EMPTY", "d").alias("d")).collect()
    assert json.loads(got[0].a) == {"a": {"b": "}; {"}, "c": '"}'} and (got[0].b, got[0].n, got[0].k, got[0].d) == (None, None, "val", "d") and got[1].a is None
    long = "Para one. It has words.\n\nPara two is here! " + "word " * 30
    chunks = spark.createDataFrame([(long,), (" ",), (None,)], "t string").select(T.recursive_chunks("t", 8).alias("c")).collect()
    assert " ".join(chunks[0].c).split() == long.split() and all(len(c.split()) <= 8 for c in chunks[0].c) and chunks[0].c[0] == "Para one. It has words." and chunks[1].c == chunks[2].c == []
