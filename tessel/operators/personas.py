"""Personas and prompt trees as XML and bundles: read as rows, checked, written back; their knowledge and memories."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions.text import slug, strip, xml_escape, xml_legal
from tessel.operators import index
from tessel.operators.retrieval import attribute
from tessel.tables import numbered, saved, shared_dir

#: Prompts of a tree that one file holds.
PIECE = 20_000

#: Version of a definition, kinds of pipeline steps and of retrieval.
VERSION, STEPS, MODES = "1", ("llm", "knowledge_retrieval", "memory_retrieval"), ("vector", "keyword", "hybrid")
_PROFILE, _SPEAKING, _STORES = ("name", "bio", "role", "avatar"), ("tone", "formality", "vocabulary", "quirks"), ("knowledge", "memories", "sources")
DEFINITION = (
    "struct<_version:string,profile:struct<name:string,bio:string,role:string,avatar:string>,"
    "speaking:struct<tone:string,formality:string,vocabulary:string,quirks:string,variant:array<struct<_name:string,_VALUE:string>>,example:array<struct<user:string,reply:string>>>,"
    "models:struct<chat_model:string,embedding_model:string,temperature:string>,"
    "stores:struct<_knowledge:string,_memories:string,_sources:string,_retrieval:string,_prompt_reword:string,_embedding_model_used:string,_VALUE:string>,"
    "pipeline:struct<step:array<struct<_id:string,_type:string,_use_history:string,_model:string,prompt:string,schema:string>>>>"
)


def _some(x, default: str = "") -> Column:
    return F.coalesce(x, F.lit(default))


def read_definitions(rows: DataFrame) -> DataFrame:
    """(id, name, error, persona) of definitions (id, xml). A broken one is listed with its id as name and says why, so that it
    can be seen and deleted; an unknown way of retrieval becomes hybrid, anything else that is wrong is an error."""
    p = F.from_xml("xml", DEFINITION, {"valueTag": "_VALUE", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})
    own = rows.withColumn("__p", F.when(F.col("xml").rlike(r"(?s)^\s*(<\?xml[^>]*\?>\s*)?<persona\b"), p))
    step = "__p.pipeline.step"
    bad_step = F.get(F.filter(F.col(step), lambda s: ~_some(s["_type"], "llm").isin(*STEPS)), F.lit(0))["_type"]
    bad_schema = F.exists(step, lambda s: (strip(_some(s["schema"])) != "") & F.json_array_length(F.concat(F.lit("["), s["schema"], F.lit("]"))).isNull())
    unsafe = lambda c: _some(F.col(f"__p.stores._{c}"), f"{c}/").rlike(r"^/|^[A-Za-z]:|(^|[\\/])\.\.([\\/]|$)")
    error = (
        F.when(F.col("__p").isNull() | F.col("__p.profile").isNull() & F.col("__p._version").isNull(), "not a persona definition")
        .when(_some(F.col("__p._version")) != VERSION, "unsupported version")
        .when(strip(_some(F.col("__p.profile.name"))) == "", "no name")
        .when(F.greatest(*[unsafe(c) for c in _STORES]), "unsafe store path")
        .when(bad_step.isNotNull(), F.concat(F.lit("unknown step type "), bad_step))
        .when(_some(bad_schema, False), "invalid schema")
    )
    text = lambda path, default="": _some(F.col(f"__p.{path}"), default)
    retrieval = F.lower(text("stores._retrieval", "hybrid"))
    persona = F.struct(
        *[text(f"profile.{c}").alias(c) for c in _PROFILE],
        *[text(f"speaking.{c}").alias(c) for c in _SPEAKING],
        F.coalesce(F.transform("__p.speaking.variant", lambda v: F.struct(_some(v["_name"]).alias("name"), _some(v["_VALUE"]).alias("description"))), F.array()).alias("variants"),
        F.coalesce(F.transform("__p.speaking.example", lambda e: F.struct(_some(e["user"]).alias("user"), _some(e["reply"]).alias("reply"))), F.array()).alias("examples"),
        text("models.chat_model").alias("chat_model"), text("models.embedding_model", "nomic-embed-text").alias("embedding_model"), F.coalesce(F.col("__p.models.temperature").try_cast("double"), F.lit(0.7)).alias("temperature"),
        *[text(f"stores._{c}", f"{c}/").alias(c) for c in _STORES],
        F.when(retrieval.isin(*MODES), retrieval).otherwise("hybrid").alias("retrieval"), (F.lower(text("stores._prompt_reword", "true")) != "false").alias("prompt_reword"), text("stores._embedding_model_used").alias("embedding_model_used"),
        F.coalesce(F.transform(step, lambda s: F.struct(_some(s["_id"]).alias("id"), _some(s["_type"], "llm").alias("type"), _some(s["_model"]).alias("model"), (F.lower(_some(s["_use_history"])) == "true").alias("use_history"), _some(s["prompt"]).alias("prompt"), s["schema"].alias("schema"))), F.array()).alias("pipeline"),
    )
    marked = own.withColumn("error", error)
    return marked.select("id", F.when(F.col("error").isNull(), text("profile.name")).otherwise(F.col("id")).alias("name"), "error", F.when(F.col("error").isNull(), persona).alias("persona"))


def definition(persona: Column | str) -> Column:
    """The XML of a persona as read_definitions() gives it; the id is its folder's name and not stored."""
    p = F.col(persona) if isinstance(persona, str) else persona
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), xml_escape(xml_legal(_some(x))), F.lit(f"</{name}>"))
    attr = lambda name, x: F.concat(F.lit(f" {name}="), attribute(xml_legal(_some(x))))
    variants = F.array_join(F.transform(p["variants"], lambda v: F.concat(F.lit("<variant"), attr("name", v["name"]), F.lit(">"), xml_escape(xml_legal(v["description"])), F.lit("</variant>"))), "")
    examples = F.array_join(F.transform(p["examples"], lambda e: F.concat(F.lit("<example>"), tag("user", e["user"]), tag("reply", e["reply"]), F.lit("</example>"))), "")
    schema = lambda s: F.when(s["schema"].isNotNull(), tag("schema", s["schema"])).otherwise("")
    model = lambda s: F.when(_some(s["model"]) != "", attr("model", s["model"])).otherwise("")
    steps = F.array_join(F.transform(p["pipeline"], lambda s: F.concat(F.lit("<step"), attr("id", s["id"]), attr("type", s["type"]), attr("use_history", s["use_history"].cast("string")), model(s), F.lit(">"), tag("prompt", s["prompt"]), schema(s), F.lit("</step>"))), "")
    stores = F.concat(*[attr(c, p[c]) for c in (*_STORES, "retrieval")], attr("prompt_reword", p["prompt_reword"].cast("string")), attr("embedding_model_used", p["embedding_model_used"]))
    return F.concat(
        F.lit(f'<persona version="{VERSION}"><profile>'), *[tag(c, p[c]) for c in _PROFILE], F.lit("</profile><speaking>"), *[tag(c, p[c]) for c in _SPEAKING], variants, examples,
        F.lit("</speaking><models>"), tag("chat_model", p["chat_model"]), tag("embedding_model", p["embedding_model"]), tag("temperature", p["temperature"].cast("string")), F.lit("</models><stores"), stores, F.lit("/><pipeline>"), steps, F.lit("</pipeline></persona>"),
    )


def fresh_ids(new: DataFrame, known: DataFrame) -> DataFrame:
    """Adds id to new personas (pos, name): the name as a slug, with -2, -3, ... behind what is known (id) or came before."""
    base = F.when(slug("name") == "", "persona").otherwise(slug("name"))
    own = new.withColumn("__base", base)
    root = F.regexp_replace("id", r"-\d+$", "")
    number = F.coalesce(F.regexp_extract("id", r"-(\d+)$", 1).try_cast("int"), F.lit(1))
    both = known.select(root.alias("__base"), number.alias("__n")).unionByName(known.select(F.col("id").alias("__base"), F.lit(1).alias("__n")))
    used = both.groupBy("__base").agg(F.max("__n").alias("__n"))
    exact = known.select(F.col("id").alias("__base"), F.lit(True).alias("__is"))
    k = F.row_number().over(Window.partitionBy("__base").orderBy("pos")) - 1
    numbered = own.withColumn("__k", k).join(used, "__base", "left").join(exact.dropDuplicates(), "__base", "left")
    at = F.col("__k") + F.when(F.col("__is"), F.greatest(F.col("__n"), F.lit(1))).otherwise(F.when(F.col("__k") == 0, 0).otherwise(F.greatest(F.coalesce("__n", F.lit(1)), F.lit(1)) - 1))
    return numbered.withColumn("id", F.when(at == 0, F.col("__base")).otherwise(F.concat("__base", F.lit("-"), (at + 1).cast("string")))).drop("__base", "__k", "__n", "__is")


def safe_member(name: Column) -> Column:
    """What a bundle may hold: the definition, sources and memory entries, and no way out of its folder."""
    n = F.replace(name, F.lit("\\"), F.lit("/"))
    way_out = n.startswith("/") | n.rlike(r"^.:") | F.array_contains(F.split(n, "/"), "..")
    return ~way_out & ((n == "persona.xml") | n.startswith("sources/") | n.startswith("memories/entries/"))


def bundle_members(files: DataFrame) -> DataFrame:
    """(path, member, data, error) of bundles (path, content: binary). A bundle with one unsafe member gives that member as an
    error and no data; one that is no archive gives a row with its error. Folders are left out."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        rows += [(path, m.filename, z.read(m), None) for m in z.infolist() if not m.is_dir()]
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "member", "data", "error"])

    own = files.select("path", "content").mapInPandas(run, "path string, member string, data binary, error string")
    bad = F.col("member").isNotNull() & ~safe_member(F.col("member"))
    own = own.withColumn("__refused", F.max(bad).over(Window.partitionBy("path")))
    own = own.withColumn("error", F.when(bad, "unsafe member").otherwise(F.col("error"))).withColumn("data", F.when(~F.col("__refused"), F.col("data")))
    return own.where(F.col("error").isNotNull() | ~F.col("__refused")).drop("__refused")


def bundles(members: DataFrame) -> DataFrame:
    """(path, content): archives of (path, member, data), unsafe members left out. A bundle is one file, so it is put together
    in one task."""

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        with zipfile.ZipFile(buffer := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
            for m, data in sorted(zip(own["member"], own["data"])):
                z.writestr(m, bytes(data))
        return pd.DataFrame({"path": own["path"].iloc[:1], "content": [buffer.getvalue()]})

    return members.where(safe_member(F.col("member"))).groupBy("path").applyInPandas(pack, "path string, content binary")


def knowledge_items(files: DataFrame) -> DataFrame:
    """Extracted source files (persona, path, ok, text) and their names as items of the index; the name is the item."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where("ok").select(F.lit("persona_knowledge").alias("source_type"), F.col("persona").alias("source_id"), name.alias("item_id"), F.col("text").alias("content"), F.to_json(F.struct(name.alias("label"))).alias("meta"))


def memory_items(memories: DataFrame) -> DataFrame:
    """Memories (persona, id, title, description) as items of the index: title and description are what is searched."""
    text = strip(F.concat(_some(F.col("title")), F.lit("\n"), _some(F.col("description"))))
    return memories.select(F.lit("persona_memory").alias("source_type"), F.col("persona").alias("source_id"), F.col("id").alias("item_id"), text.alias("content"), F.to_json(F.struct(F.col("title").alias("label"))).alias("meta")).where("content <> ''")


def compile_persona(files: DataFrame, memories: DataFrame, stored: DataFrame, old: DataFrame, embed, model: str, size: int = 512, overlap: int = 64) -> tuple[DataFrame, DataFrame]:
    """(next store, next manifest) of personas from their extracted files and their memories in one compile.

    Items are named k:name (knowledge) and m:id (memory), so a file and a memory of one name are two items and each is
    found, changed and pruned on its own. Files that could not be read are no items: what was compiled of them before goes."""
    keyed = lambda items, mark: items.withColumn("item_id", F.concat(F.lit(mark), "item_id"))
    return index.compile_items(keyed(knowledge_items(files), "k:").unionByName(keyed(memory_items(memories), "m:")), stored, old, embed, model, size, overlap)


def newest_first(memories: DataFrame) -> DataFrame:
    return memories.orderBy(F.desc("created"), "id")


# ---- prompt trees


def tree_xml(prompts: DataFrame, kind: str) -> DataFrame:
    """(kind, pos, line): the lines of a prompt tree (group, category, name, prompt, pos) as XML, in order; a tree may be of any
    size, so its lines stay rows (write_tree() writes them)."""
    return _lines(_placed(prompts), kind, [])


def _placed(prompts: DataFrame) -> DataFrame:
    """With the first places of each row's group (__g) and category (__c)."""
    cats = prompts.groupBy("group", "category").agg(F.min("pos").alias("__c"))
    groups = cats.groupBy(F.col("group").alias("__group")).agg(F.min("__c").alias("__g"))
    cats = cats.join(groups, F.col("group").eqNullSafe(F.col("__group"))).select("__group", F.col("category").alias("__category"), "__g", "__c")
    return prompts.join(cats, F.col("group").eqNullSafe(F.col("__group")) & F.col("category").eqNullSafe(F.col("__category"))).drop("__group", "__category")


def _lines(own: DataFrame, kind: str, by: list) -> DataFrame:
    """(kind, by, pos, line) of rows of _placed(); where `by` parts the rows, each part opens and closes its own groups and categories."""
    text = lambda x: xml_escape(xml_legal(_some(F.col(x))))
    first, most = F.lit(-1).cast("long"), F.lit(2**62)
    at = lambda b, c: F.struct(F.col("__g").cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c")).alias("pos")
    group, cat = own.select(*by, "group", "__g").distinct(), own.select(*by, "group", "category", "__g", "__c").distinct()
    out = [
        group.select(*by, at(first, first), F.concat(F.lit("<group name="), attribute(F.col("group")), F.lit(">")).alias("line")),
        cat.select(*by, at(F.col("__c"), first), F.concat(F.lit("<category name="), attribute(F.col("category")), F.lit(">")).alias("line")),
        own.select(*by, at(F.col("__c"), F.col("pos")), F.concat(F.lit("<prompt name="), attribute(F.col("name")), F.lit(">"), text("prompt"), F.lit("</prompt>")).alias("line")),
        cat.select(*by, at(F.col("__c"), most), F.lit("</category>").alias("line")),
        group.select(*by, at(most, most), F.lit("</group>").alias("line")),
    ]
    return reduce(DataFrame.unionByName, out).select(F.lit("pre" if kind == "pre" else "system").alias("kind"), *by, "pos", "line")


def write_tree(prompts: DataFrame, kind: str, path: str, most: int = PIECE) -> None:
    """The tree as files of `most` prompts, each under its own <prompts> root, in folders by piece: no task writes or reads it whole. A
    group or category that goes over the end of a piece is opened again in the next one."""
    rows = numbered(_placed(prompts), ["__g", "__c", "pos"], "__k").withColumn("piece", F.floor(F.col("__k") / most)).drop("__k")
    rows = saved(rows, shared_dir(prompts.sparkSession), "pieces")
    lines = _lines(rows, kind, ["piece"])
    end = lambda n, line: rows.select("piece").distinct().select("piece", F.struct(*[F.lit(n).cast("long").alias(c) for c in "abc"]).alias("pos"), F.lit(line).alias("line"))
    whole = lines.drop("kind").unionByName(end(-(2**62), f'<prompts kind="{"pre" if kind == "pre" else "system"}">')).unionByName(end(2**62 + 1, "</prompts>"))
    whole.repartition("piece").sortWithinPartitions("piece", "pos").select("piece", "line").write.partitionBy("piece").text(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(kind, group, category, name, prompt) of prompt files with a <prompts> root, in their order as pos (after that of write_tree()'s
    pieces, where it wrote them)."""
    schema = "_kind string, group array<struct<_name:string,category:array<struct<_name:string,prompt:array<struct<_name:string,_VALUE:string>>>>>>"
    root = spark.read.format("xml").option("rowTag", "prompts").option("valueTag", "_VALUE").schema(schema).load(path)
    by = [c for c in ("piece",) if c in root.columns]
    g = root.select(*by, F.when(F.col("_kind") == "pre", "pre").otherwise("system").alias("kind"), F.posexplode("group").alias("a", "g"))
    c = g.select(*by, "kind", "a", _some(F.nullif("g._name", F.lit("")), "Imported Group").alias("group"), F.posexplode("g.category").alias("b", "c"))
    p = c.select(*by, "kind", "a", "b", "group", _some(F.nullif("c._name", F.lit("")), "Uncategorized").alias("category"), F.posexplode("c.prompt").alias("d", "p"))
    return p.select("kind", "group", "category", _some(F.nullif("p._name", F.lit("")), "Untitled").alias("name"), _some(F.col("p._VALUE")).alias("prompt"), F.struct(*by, "a", "b", "d").alias("pos"))


def slice_tree(prompts: DataFrame, kind: str, group: str, category: str | None = None, name: str | None = None) -> DataFrame:
    """The most specific subtree that is named, with its ancestors as columns; nothing if what is named is not there."""
    out = prompts.where((F.col("kind") == ("pre" if kind == "pre" else "system")) & (F.col("group") == group))
    out = out.where(F.col("category") == category) if category else out
    return out.where(F.col("name") == name) if category and name else out


def from_presets(presets: DataFrame) -> DataFrame:
    """Flat presets (name, prompt) as prompts of a tree."""
    return presets.select(F.lit("system").alias("kind"), F.lit("Imported").alias("group"), F.lit("Uncategorized").alias("category"), _some(F.nullif("name", F.lit("")), "Untitled").alias("name"), _some(F.col("prompt")).alias("prompt"))


def migrated_prompts(chats: DataFrame) -> DataFrame:
    """Chats whose single prompt with a flag becomes a system prompt and a pre prompt, each with its switch. Chats that have the
    switches stay as they are; changed says whether a row was touched."""
    done = F.col("system_on").isNotNull() & F.col("pre_on").isNotNull() & F.col("system_prompt").isNotNull()
    pre = _some(F.col("pre_prompt"))
    as_system = (strip(pre) != "") & F.coalesce("pre_as_system", F.lit(True))
    system = F.when(as_system, pre).otherwise(_some(F.col("system_prompt")))
    new = {"system_prompt": system, "system_on": F.when(as_system, True).otherwise(strip(_some(F.col("system_prompt"))) != ""), "pre_prompt": F.when(as_system, "").otherwise(pre), "pre_on": F.when(as_system, False).otherwise(strip(pre) != "")}
    return chats.withColumns({k: F.when(done, F.col(k)).otherwise(v) for k, v in new.items()} | {"changed": ~done})


__all__ = ["bundle_members", "bundles", "definition", "fresh_ids", "from_presets", "knowledge_items", "memory_items", "migrated_prompts", "newest_first", "read_definitions", "read_tree", "safe_member", "slice_tree", "tree_xml", "write_tree"]
