"""Batches: checks of a project, names of output files, bodies, files and combined files, the audit log."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions.text import col, strip, strip_markdown
from tessel.sources.files import folder
from tessel.tables import saved, shared_dir

#: What a file name cannot hold, names of devices, the longest stem.
BAD_CHARS, MAX_STEM = r"[<>:\"/\\|?*\x00-\x1f]", 120
RESERVED = ("con", "prn", "aux", "nul", *(f"com{k}" for k in range(1, 10)), *(f"lpt{k}" for k in range(1, 10)))
RULE = "\n\n---\n\n"
SOURCES = {"youtube": "urls", "playlist": "url", "rss": "url", "search": "query", "folder": "path", "images": "path", "media": "path"}
ON_DISK = ("folder", "images", "media")


def problems(projects: DataFrame) -> DataFrame:
    """(project, pos, problem): what would make a run of each project (project, model, sources: array of (kind, value), files,
    export_mode, name_prefix, name_suffix, output_dir) fail or overwrite what it reads."""
    blank = lambda x: strip(F.coalesce(x, F.lit(""))) == ""
    kinds = F.transform(F.coalesce("sources", F.array()), lambda s: strip(F.coalesce(s["kind"], F.lit(""))))

    def of_source(s: Column, k: Column) -> Column:
        kind = strip(F.coalesce(s["kind"], F.lit("")))
        n = F.concat(F.lit("Source "), (k + 1).cast("string"))
        return F.when(~kind.isin(*SOURCES), F.concat(n, F.lit(": unknown input type '"), kind, F.lit("'."))).when(blank(s["value"]), F.concat(n, F.lit(": nothing was given.")))

    beside = F.col("files") & (F.coalesce("export_mode", F.lit("per_item")) == "beside_source")
    own = F.concat(
        F.array(F.when(blank(F.col("model")), "No model selected."), F.when(F.size(kinds) == 0, "Add at least one input source.")),
        F.transform(F.coalesce("sources", F.array()), of_source),
        F.array(
            F.when(beside & blank(F.col("name_prefix")) & blank(F.col("name_suffix")), "Saving next to the original files needs a name prefix or suffix."),
            F.when(beside & ~F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in ON_DISK])), "Saving next to the original files only works for folder sources."),
            F.when(F.col("files") & ~beside & blank(F.col("output_dir")), "Choose an output folder for the exported files."),
        ),
    )
    return projects.select("project", F.posexplode(F.filter(own, lambda p: p.isNotNull())).alias("pos", "problem"))


def file_stem(name) -> Column:
    """Any text as a file name without its suffix: no separators, no devices, no dots at its ends, never empty."""
    bare = strip(F.regexp_replace(F.regexp_replace(F.coalesce(col(name).cast("string"), F.lit("")), BAD_CHARS, " "), r"\s+", " "))
    bare = F.regexp_replace(bare, r"^[. ]+|[. ]+$", "")
    named = F.when(bare == "", "untitled").when(F.lower(bare).isin(*RESERVED), F.concat(bare, F.lit("_"))).otherwise(bare)
    short = strip(F.substring(named, 1, MAX_STEM))
    return F.when(short == "", "untitled").otherwise(short)


def output_paths(items: DataFrame, mode: str = "per_item", output_dir: str = "", prefix: str = "", suffix: str = "", ext: str = ".md", by_title: bool = False, taken: DataFrame | None = None) -> DataFrame:
    """Adds path and error to items (pos, title, source_path, chosen_title): where each answer goes.

    The name is the chosen title (if by_title and there is one), the stem of the source file, or the title. Beside its source
    an item needs a source file and a prefix or suffix, and never gets the source's own path. Names that would be the same,
    of items or in `taken` (path), get " (2)", " (3)", ... in order of pos."""
    ext = ext if ext.startswith(".") else f".{ext}"
    source = F.nullif(F.coalesce("source_path", F.lit("")), F.lit(""))
    name = F.regexp_extract(source, r"([^/]*)$", 1)
    stem_of = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    chosen = F.when(F.lit(by_title) & (strip(F.coalesce("chosen_title", F.lit(""))) != ""), F.col("chosen_title"))
    base = F.coalesce(chosen, stem_of, F.nullif(F.coalesce("title", F.lit("")), F.lit("")), F.lit("untitled"))
    stem = file_stem(F.concat(F.lit(prefix.strip()), file_stem(base), F.lit(suffix.strip())))
    beside = mode == "beside_source"
    folder = F.regexp_replace(source, r"/?[^/]*$", "") if beside else F.lit(output_dir.strip().rstrip("/"))
    error = F.when(F.lit(beside) & source.isNull(), "has no file on disk").when(F.lit(beside and not prefix.strip() and not suffix.strip()), "needs a name prefix or suffix")
    error = error.when(F.lit(not beside and not output_dir.strip()), "no output folder").when(F.lit(beside) & F.concat_ws("/", folder, F.concat(stem, F.lit(ext))).eqNullSafe(source), "matches the source file")
    named = items.withColumn("error", error).withColumn("__stem", F.when(F.col("error").isNull(), F.concat_ws("/", F.nullif(folder, F.lit("")), stem)))
    # a name with its number may be another item's own name: numbers go on behind all that are taken
    all_ = named.where("__stem is not null").select(F.lit(1).alias("own"), F.col("__stem").alias("s"), "pos")
    if taken is not None:
        all_ = all_.unionByName(taken.where(F.col("path").endswith(ext)).select(F.lit(0).alias("own"), F.expr(f"substr(path, 1, length(path) - {len(ext)})").alias("s"), F.lit(None).cast(named.schema["pos"].dataType).alias("pos")))
    root = F.regexp_replace("s", r" \((\d+)\)$", "")
    number = F.coalesce(F.regexp_extract("s", r" \((\d+)\)$", 1).try_cast("int"), F.lit(1))
    rows = all_.select("own", "pos", root.alias("root"), "s", number.alias("number"))
    used = rows.groupBy("root").agg(F.max("number").alias("most"))
    k = F.row_number().over(Window.partitionBy("s").orderBy("own", "pos"))
    repeat = rows.withColumn("k", k)
    extra = F.row_number().over(Window.partitionBy("root").orderBy("own", "pos"))
    later = repeat.where("k > 1 and own = 1").withColumn("n", extra).join(used, "root").select("pos", F.concat("root", F.lit(" ("), F.col("most") + F.col("n"), F.lit(")")).alias("path"))
    first = repeat.where("k = 1 and own = 1").select("pos", F.col("s").alias("path"))
    paths = first.unionByName(later).select("pos", F.concat("path", F.lit(ext)).alias("path"))
    return named.drop("__stem").join(paths, "pos", "left")


def body(title: Column, origin: Column, content: Column, prompt: Column, response: Column, with_source: bool = False, with_prompt: bool = False, plain: bool = False) -> Column:
    """What goes into a file: the answer (without marks of Markdown if `plain` and something is left), behind its source and
    its prompt if these are wanted."""
    said = F.coalesce(response, F.lit(""))
    if plain:
        said = F.when(strip_markdown(said) != "", strip_markdown(said)).otherwise(said)
    if not with_source and not with_prompt:
        return said
    some = lambda x: F.coalesce(x, F.lit(""))
    parts = []
    if with_source:
        parts.append(F.concat(F.lit("# Source: "), some(title), F.when(some(origin) != "", F.concat(F.lit("\n"), origin)).otherwise(""), F.lit("\n\n"), some(content)))
    if with_prompt:
        parts.append(F.concat(F.lit("# Prompt\n\n"), some(prompt)))
    return F.concat_ws(RULE, *parts, F.concat(F.lit("# Response\n\n"), said))


def combined(results: DataFrame) -> DataFrame:
    """(pos, text): the part of each result (pos, title, body) in one combined file, in order."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))
    return results.select("pos", F.concat(F.lit("# "), title, F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text"))


def write_combined(parts: DataFrame, path: str) -> None:
    """Writes the parts in order, with a rule behind each; the files of the folder, one after the other, are the combined
    file, so no task holds it whole."""
    parts.sort("pos").select("text").write.mode("overwrite").option("lineSep", RULE).text(path)


def write_files(files: DataFrame) -> DataFrame:
    """(path, ok, error): writes (path, data: string or binary) as a file each, from the tasks; one that fails fails alone."""

    def run(batches):
        import pyarrow.fs

        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["data"]):
                try:
                    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    with fs.open_output_stream(at) as out:
                        out.write(data.encode() if isinstance(data, str) else bytes(data))
                    rows.append((path, True, None))
                except Exception as e:
                    rows.append((path, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ok", "error"])

    return files.select("path", "data").mapInPandas(run, "path string, ok boolean, error string")


def answered_folder(spark: SparkSession, path: str, ask, suffixes: tuple[str, ...] = (".txt", ".md")) -> DataFrame:
    """(path, ok, error): every text of a folder is a prompt, answered by ask(DataFrame of path, prompt) -> (path, response), and its answer
    is written under the prompt's name and suffix to the folder `responses` inside. Folders inside are not read, so answers never become prompts. A blank
    prompt is not asked, and one without answer is not written: both are rows with an error."""
    files = folder(spark, path, suffixes, recursive=False)
    prompts = saved(files.select("path", strip(F.decode("content", "utf-8")).alias("prompt")), shared_dir(spark), "prompts")
    answers = ask(prompts.where("prompt <> ''")).select("path", "response")
    both = saved(prompts.join(answers, "path", "left"), shared_dir(spark), "answers")
    to = F.regexp_replace("path", "([^/]+)$", "responses/$1")
    done = write_files(both.where("response is not null").select(to.alias("path"), F.col("response").alias("data")))
    why = F.when(F.col("prompt") == "", "empty prompt").otherwise("no answer")
    return done.unionByName(both.where("response is null").select("path", F.lit(False).alias("ok"), why.alias("error")))


def append_audit(entries: DataFrame, path: str) -> None:
    """Appends entries as JSON lines."""
    entries.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, schema: str, limit: int = 500, offset: int = 0, order: str = "seq") -> DataFrame:
    """Entries, newest first; lines that are no JSON are passed over."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = rows.where(F.col("_bad").isNull() & F.col(order).isNotNull()).drop("_bad")
    return good.orderBy(F.desc(order)).offset(offset).limit(limit)


def count_audit(spark: SparkSession, path: str) -> int:
    """Lines of the log that are not blank, whether they can be read or not."""
    return spark.read.text(path).where(F.trim("value") != "").count()
