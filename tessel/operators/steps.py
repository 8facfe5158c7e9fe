"""Chains of model calls over tables of runs: ordered steps with a shared context, refinement in rounds, situating contexts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import strip, summary
from tessel.operators.evals import complete, parse_reply
from tessel.operators.retrieval import excerpts
from tessel.tables import saved, shared_dir, small_batches

RETRIES = 3
CONTEXT = "map<string,string>"
_MARK = re.compile(r"\{(\w+)\}")


def filled(template: str, context: dict[str, str]) -> str:
    """The template with {name} from the context; names that are not there stay as they are, so JSON in a prompt does."""
    return _MARK.sub(lambda m: context[m[1]] if m[1] in context else m[0], template or "")


def invalid(found, schema: dict) -> str | None:
    """What is wrong with a JSON object by the required fields and the types of its schema, or None."""
    kinds = {"string": str, "array": list, "object": dict, "number": (int, float), "integer": int, "boolean": bool}
    if not isinstance(found, dict):
        return "response was not valid JSON"
    for key in schema.get("required") or []:
        if key not in found:
            return f"missing required field '{key}'"
    for key, about in (schema.get("properties") or {}).items():
        kind = kinds.get(about.get("type"))
        if key in found and kind and not isinstance(found[key], kind):
            return f"field '{key}' must be {about['type']}"
    return None


def _asked(rows: DataFrame, step: dict, identity: str, model, retries: int) -> DataFrame:
    """One model step of all rows; a step with a schema is asked again with what was wrong, so many times in all."""
    name, template, schema = step["id"], step.get("prompt", ""), step.get("schema")

    def one(context: dict, history: str) -> tuple[dict, str | None]:
        parts = [identity] if identity else []
        if step.get("use_history") and history:
            parts.append(f"Conversation so far:\n{history}")
        prompt, error = "\n\n".join([*parts, filled(template, context)]), None
        if schema is None:
            said = (model([prompt])[0] or "").strip()
            return context | {name: said, "draft": context.get("draft") or said, "final": said}, None
        for _ in range(max(1, retries)):
            more = f"\n\nYour previous reply was invalid: {error}. Reply again with ONLY valid JSON matching the required fields." if error else ""
            found = parse_reply(model([prompt + more])[0])
            error = invalid(found or None, schema)
            if error is None:
                text = lambda v: v if isinstance(v, str) else json.dumps(v)
                return context | {name: json.dumps(found)} | {k: text(v) for k, v in found.items()}, None
        return context, error

    def run(batches):
        for b in batches:
            out = []
            for context, history, error in zip(b["context"], b["history"], b["error"]):
                context = dict(context)
                if error is None:
                    try:
                        context, error = one(context, history or "")
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                out.append((context, error))
            yield b.assign(context=[c for c, _ in out], error=[e for _, e in out])

    return rows.mapInPandas(run, rows.schema)


def run_steps(runs: DataFrame, steps: Sequence[dict], model, search: dict[str, Callable[[DataFrame], DataFrame]] | None = None, identity: str = "", retries: int = RETRIES, start: int = 0) -> DataFrame:
    """(run, message, history, context, error, paused): the runs (run, message, history, and context to go on from) after all
    steps {id, type, prompt, schema, use_history} from `start` on. A run whose step fails is paused there, with the context
    that it had, and the others go on; fix it and call again with its rows and start=paused.

    type is llm, or a name in `search`: a function of questions (query: run, q) -> ranked rows (query, rank, item_id, source_id,
    content), whose excerpts become the context's entry of that name. Questions are those that an earlier step put into
    <name>_queries (a JSON list), else the message. Each step is written, so a model is asked once."""
    folder, search = shared_dir(runs.sparkSession), search or {}
    given = F.coalesce(F.col("context"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) if "context" in runs.columns else F.create_map().cast(CONTEXT)
    rows = runs.select("run", "message", "history", F.map_concat(F.map_filter(given, lambda k, v: k != "message"), F.create_map(F.lit("message"), F.coalesce("message", F.lit("")))).cast(CONTEXT).alias("context"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("paused"))
    for k, step in list(enumerate(steps))[start:]:
        if step.get("type", "llm") == "llm":
            rows = _asked(rows, step, identity, model, retries)
        else:
            name = step["type"]
            wanted = F.from_json(F.try_element_at("context", F.lit(f"{name}_queries")), "array<string>")
            q = F.when(F.coalesce(F.size(wanted), F.lit(0)) > 0, F.array_join(wanted, " ")).otherwise(F.col("message"))
            found = search[name](rows.where("error is null").select(F.col("run").alias("query"), q.alias("q")))
            text = excerpts(found, ["query"]).select(F.col("query").alias("run"), "excerpts")
            put = lambda x: F.map_concat(F.map_filter("context", lambda key, v: key != name), F.create_map(F.lit(name), x))  # noqa: E731, B023
            rows = rows.join(text, "run", "left").withColumn("context", F.when(F.col("error").isNull(), put(F.coalesce("excerpts", F.lit("(none found)")))).otherwise(F.col("context"))).drop("excerpts")
        paused = F.when(F.col("error").isNotNull(), F.coalesce("paused", F.lit(k)))
        rows = saved(rows.withColumn("paused", paused).select("run", "message", "history", "context", "error", "paused"), folder, f"step{k}")
    return rows


def refined(rows: DataFrame, model, review: str, passes: int = 2) -> DataFrame:
    """(row, round, answer, intermediate): the answer to each prompt (row, prompt) and so many rounds in which the model reviews
    its last one (review: a template of {{ prompt }} and {{ answer }}). All but the last are intermediate; a round that fails
    keeps the answer before."""
    folder = shared_dir(rows.sparkSession)
    now = saved(complete(rows.select("row", "prompt"), model, out="answer"), folder, "round0")
    rounds = [now.select("row", F.lit(0).alias("round"), "answer")]
    for k in range(1, passes + 1):
        text = F.lit(review)
        for name in ("prompt", "answer"):
            text = F.call_function("array_join", F.split(text, rf"\{{\{{\s*{name}\s*\}}\}}", -1), F.coalesce(name, F.lit("")))
        asked = complete(now.withColumn("__asked", text), model, "__asked", "__said")
        now = saved(asked.select("row", "prompt", F.coalesce("__said", "answer").alias("answer")), folder, f"round{k}")
        rounds.append(now.select("row", F.lit(k).alias("round"), "answer"))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.withColumn("intermediate", F.col("round") < passes)


def situated(chunks: DataFrame, items: DataFrame, model, words: int = 120) -> DataFrame:
    """Adds context to chunks (item_id, content): what model says of the place of each chunk in its item (item_id, content),
    of which it sees the first words. A call that fails leaves an empty context, and the chunk is indexed as it is."""
    small_batches(chunks.sparkSession)
    about = items.select("item_id", summary("content", words).alias("__about"))
    prompt = F.concat(F.lit("Document:\n"), "__about", F.lit("\n\nExcerpt:\n"), "content", F.lit("\n\nSay in one sentence where this excerpt stands in the document."))
    said = complete(chunks.join(about, "item_id").withColumn("__prompt", prompt), model, "__prompt", "__said")
    return said.withColumn("context", strip(F.coalesce("__said", F.lit("")))).drop("__prompt", "__said", "__about")


def improved(rows: DataFrame, model) -> DataFrame:
    """Adds better to instructions (row, text, history): what model makes of them, without the label that it may repeat; blank
    ones, and those of which nothing comes, stay."""
    before = F.when(F.coalesce("history", F.lit("")) != "", F.concat(F.lit("Conversation context (for reference only):\n"), "history", F.lit("\n\n"))).otherwise("")
    asked = rows.withColumn("__prompt", F.concat(before, F.lit("Original instruction:\n"), F.coalesce("text", F.lit("")), F.lit("\n\nRewritten instruction:")))
    said = complete(asked, model, "__prompt", "__said")
    bare = F.regexp_replace(strip(F.coalesce("__said", F.lit(""))), r"(?i)^(rewritten instruction|instruction)\s*:\s*", "")
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    return said.withColumn("better", F.when(blank | (bare == ""), F.coalesce("text", F.lit(""))).otherwise(bare)).drop("__prompt", "__said")
