"""Sources and sinks: text folders, documents, CSV text, XML and JSON envelopes, JDBC, captions."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import strip, xml_escape, xml_legal

TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".csv", ".json", ".log", ".rst")


def folder(spark: SparkSession, path: str, suffixes: Sequence[str] = TEXT_SUFFIXES, recursive: bool = True) -> DataFrame:
    """(path, content, ...) of the files of a folder by suffix, with their place by lower-cased path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(F.lower("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))


def in_order(files: DataFrame) -> DataFrame:
    return files.orderBy(F.lower("path"), "path")


def extract(files: DataFrame) -> DataFrame:
    """(path, ok, title, text, format, error): text of plain, HTML, word-processor and e-book files; a file that cannot be
    read is a row with its error, never the end of the job."""

    def read(path: str, data: bytes) -> tuple[str, str]:
        suffix = path.rsplit(".", 1)[-1].lower()
        if suffix in ("docx", "epub"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                if suffix == "docx":
                    root = ElementTree.fromstring(z.read("word/document.xml"))
                    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
                    body = root.find(f"{w}body")
                    line = lambda p: "".join(t.text or "" for t in p.iter(f"{w}t"))
                    paragraphs = [line(p) for p in body.findall(f"{w}p")]
                    rows = [" | ".join("".join(line(p) for p in c.iter(f"{w}p")) for c in r.iter(f"{w}tc")) for t in body.findall(f"{w}tbl") for r in t.iter(f"{w}tr")]
                    return "\n".join(x for x in paragraphs + rows if x.strip()), suffix
                pages = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
                return "\n\n".join(plain(z.read(n).decode("utf-8", "replace")) for n in pages), suffix
        text = data.decode("utf-8", "replace")
        if suffix in ("html", "htm", "xhtml"):
            return plain(text), "html"
        if f".{suffix}" in TEXT_SUFFIXES:
            return text, suffix
        raise ValueError(f"no reader for .{suffix}")

    def plain(text: str) -> str:
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", text)
        return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", bare))).strip()

    def run(batches):
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                title = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    text, kind = read(path, bytes(data))
                    if not text.strip():
                        raise ValueError("no text")
                    rows.append((path, True, title, text, kind, None))
                except Exception as e:
                    rows.append((path, False, title, None, path.rsplit(".", 1)[-1].lower(), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ok", "title", "text", "format", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, ok boolean, title string, text string, format string, error string")


def csv_headers(names: Sequence[str | None]) -> list[str]:
    """Header cells as column names: trimmed, blanks numbered, repeats with (k)."""
    seen: dict[str, int] = {}
    out = []
    for k, raw in enumerate(names, 1):
        name = (raw or "").strip() or f"Column {k}"
        seen[name] = seen.get(name, -1) + 1
        out.append(name if not seen[name] else f"{name} ({seen[name]})")
    return out


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with quotes and line breaks in cells; every cell a trimmed text, short rows padded, blank rows dropped."""
    raw = spark.read.option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    rows = raw.select(F.monotonically_increasing_id().alias("__row"), *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in raw.columns])
    filled = rows.where(F.concat(*raw.columns) != "")
    head = filled.orderBy("__row").first()
    if head is None:
        return filled.drop("__row")
    # the header alone goes: a later row that says the same is data
    return filled.where(F.col("__row") != head["__row"]).drop("__row").toDF(*csv_headers(list(head)[1:]))


def items_xml(items: DataFrame) -> DataFrame:
    """One <item> text for each row (id, type, label, content)."""
    attr = lambda c: F.replace(xml_escape(xml_legal(F.coalesce(F.col(c), F.lit("")))), F.lit('"'), F.lit("&quot;"))
    return items.select("id", F.concat(F.lit('<item id="'), attr("id"), F.lit('" type="'), attr("type"), F.lit('" label="'), attr("label"), F.lit('">'), xml_escape(xml_legal(F.coalesce("content", F.lit("")))), F.lit("</item>")).alias("xml"))


def read_items_xml(spark: SparkSession, path: str) -> DataFrame:
    schema = "_id string, _type string, _label string, _VALUE string"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).select(F.col("_id").alias("id"), F.col("_type").alias("type"), F.col("_label").alias("label"), F.col("_VALUE").alias("content"))


_RSS = """guid struct<_VALUE string>, title string, link string, author string, `itunes:author` string, description string, `content:encoded` string, pubDate string, category array<string>,
`itunes:duration` string, `itunes:episode` string, `itunes:season` string, enclosure array<struct<_url string, _type string, _length string, _VALUE string>>,
`podcast:transcript` array<struct<_url string, _type string, _rel string, _language string, _VALUE string>>, `podcast:person` array<struct<_VALUE string, _role string, _group string, _href string>>,
`podcast:chapters` array<struct<_url string, _type string, _VALUE string>>"""
_ATOM = """id string, title string, link array<struct<_href string, _rel string, _type string, _length string, _VALUE string>>, author array<struct<name string>>, summary string, content struct<_VALUE string>,
published string, updated string, category array<struct<_term string, _VALUE string>>"""
_ENTRY = "guid title link author published categories body_html body_source duration episode season enclosure_url enclosure_type transcripts persons chapters_url".split()


def _text(x) -> Column:
    return strip(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RSS and Atom feeds in one shape (guid, title, link, author, published, categories, body_html, body_source,
    duration, episode, season, enclosure_url, enclosure_type, transcripts, persons, chapters_url).

    The first enclosure that is audio or video counts. Entries without guid, enclosure and link are dropped, as nothing
    could tell them apart from run to run."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("valueTag", "_VALUE").schema(schema).load(path)
    low = lambda x: F.lower(_text(x))
    media = lambda url, kind: kind.rlike("^(audio|video)/") | url.rlike(r"(?i)\.(mp3|m4a|mp4|aac|ogg|opus|wav|webm|mov)(\?|$)")
    files = lambda found: F.filter(F.transform(F.coalesce(found, F.array()), lambda e: F.struct(_text(e["_url"]).alias("url"), low(e["_type"]).alias("type"))), lambda e: (e["url"] != "") & media(e["url"], e["type"]))
    shape = lambda df, columns: df.select(*[columns[c].alias(c) for c in _ENTRY])
    rss = read("item", _RSS).withColumn("__m", F.get(files(F.col("enclosure")), F.lit(0)))
    encoded = _text("content:encoded")
    scripts = F.transform(F.filter(F.coalesce("podcast:transcript", F.array()), lambda t: _text(t["_url"]) != ""), lambda t: F.struct(_text(t["_url"]).alias("url"), low(t["_type"]).alias("type"), low(t["_rel"]).alias("rel"), low(t["_language"]).alias("language")))
    people = F.transform(F.coalesce("podcast:person", F.array()), lambda p: F.struct(_text(p["_VALUE"]).alias("name"), _text(p["_role"]).alias("role"), _text(p["_group"]).alias("group"), _text(p["_href"]).alias("href")))
    one = shape(rss, {
        "guid": _text("guid._VALUE"), "title": _text("title"), "link": _text("link"), "author": F.coalesce(F.nullif(_text("author"), F.lit("")), _text("itunes:author")), "published": _text("pubDate"),
        "categories": F.coalesce("category", F.array().cast("array<string>")), "body_html": F.when(encoded != "", encoded).otherwise(_text("description")),
        "body_source": F.when(encoded != "", "content").when(_text("description") != "", "description").otherwise(""), "duration": _text("itunes:duration"), "episode": _text("itunes:episode"), "season": _text("itunes:season"),
        "enclosure_url": F.coalesce("__m.url", F.lit("")), "enclosure_type": F.coalesce("__m.type", F.lit("")), "transcripts": scripts, "persons": people,
        "chapters_url": F.coalesce(F.get(F.filter(F.transform(F.coalesce("podcast:chapters", F.array()), lambda c: _text(c["_url"])), lambda u: u != ""), F.lit(0)), F.lit("")),
    })
    atom = read("entry", _ATOM)
    links = F.coalesce("link", F.array())
    sent = F.transform(F.filter(links, lambda x: low(x["_rel"]) == "enclosure"), lambda x: F.struct(x["_href"].alias("_url"), x["_type"].alias("_type")))
    atom = atom.withColumn("__m", F.get(files(sent), F.lit(0)))
    page = F.get(F.transform(F.filter(links, lambda x: low(x["_rel"]).isin("", "alternate")), lambda x: _text(x["_href"])), F.lit(0))
    content = _text("content._VALUE")
    empty = lambda c: F.lit(None).cast(one.schema[c].dataType)
    two = shape(atom, {
        "guid": _text("id"), "title": _text("title"), "link": F.coalesce(page, F.lit("")), "author": _text(F.get("author", F.lit(0))["name"]), "published": F.coalesce(F.nullif(_text("published"), F.lit("")), _text("updated")),
        "categories": F.transform(F.coalesce("category", F.array()), lambda c: c["_term"]), "body_html": F.when(content != "", content).otherwise(_text("summary")),
        "body_source": F.when(content != "", "content").when(_text("summary") != "", "description").otherwise(""), "duration": F.lit(""), "episode": F.lit(""), "season": F.lit(""),
        "enclosure_url": F.coalesce("__m.url", F.lit("")), "enclosure_type": F.coalesce("__m.type", F.lit("")), "transcripts": F.coalesce(empty("transcripts"), F.array().cast(one.schema["transcripts"].dataType)),
        "persons": F.coalesce(empty("persons"), F.array().cast(one.schema["persons"].dataType)), "chapters_url": F.lit(""),
    })
    return one.unionByName(two).where(F.concat("guid", "enclosure_url", "link") != "")


def jdbc(spark: SparkSession, url: str, table: str, fetch: int = 1000, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database, read in partitions by a numeric column (name, low, high, count) if one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch).options(**options)
    if partition:
        for name, value in zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), partition):
            reader = reader.option(name, value)
    return reader.load()


#: Column types of a source by their names, in the order in which names that are not here look for a key.
TYPES = {
    "SMALLINT": "smallint", "INTEGER": "int", "INT": "int", "BIGINT": "bigint",
    "BOOLEAN": "boolean", "BOOL": "boolean",
    "FLOAT": "double", "REAL": "float", "DOUBLE": "double", "DOUBLE_PRECISION": "double",
    "NUMERIC": "decimal(38,9)", "DECIMAL": "decimal(38,9)",
    "DATE": "date", "TIME": "string",
    "DATETIME": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz",
    "UUID": "string",
    "LARGEBINARY": "binary", "BINARY": "binary", "VARBINARY": "binary", "BLOB": "binary",
    "JSON": "variant", "JSONB": "variant",
    "TEXT": "string", "CLOB": "string", "STRING": "string",
    "VARCHAR": "string", "NVARCHAR": "string", "CHAR": "string", "NCHAR": "string",
}


def spark_type(name: str, precision: int | None = None, scale: int | None = None) -> str:
    """The Spark type of a source's column type."""
    up = name.upper().strip()
    if up in ("NUMERIC", "DECIMAL") and precision:
        return f"decimal({precision},{scale or 0})"
    if up in TYPES:
        return TYPES[up]
    for key, out in TYPES.items():
        if key in up:
            return out
    return "string"
