"""Text functions as Column -> Column: windows of words, hashes, tokens, templates, cleaners, renderers' helpers."""

from __future__ import annotations

import json
import re
from html import unescape as unescape_html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Windows of words: for transient text and for indexed text.
INLINE, INDEXED = (200, 40), (512, 64)


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text) -> Column:
    """Without white space of any kind at both ends (trim() knows spaces only; $ would also match before a last U+0085)."""
    return F.regexp_replace(col(text), r"^\s+|\s+\z", "")


def words(text) -> Column:
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\s+"), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """use(x) with x bound to value: worked out once for each row, however often x occurs, also within lambdas."""
    return F.transform(F.array(value), use)[0]


def word_windows(text, size: int = INLINE[0], overlap: int = INLINE[1]) -> Column:
    """Array of windows of `size` words, each `overlap` words into the one before; the last one reaches the end."""
    overlap = min(max(overlap, 0), size - 1)
    step = size - overlap

    def windows(own: Column) -> Column:
        n = F.size(own)
        count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
        starts = F.when(n > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.array_join(F.slice(own, k * step + 1, size), " "))

    return bound(words(text), windows)


def chunk_settings(size=None, overlap=None) -> tuple[int, int]:
    """Window and overlap from settings: at least 64 and 0; what is missing, zero (of the window) or no number is as indexed."""

    def number(x, default: int, least: int) -> int:
        try:
            return max(least, int(x))
        except (TypeError, ValueError):
            return default

    return number(size, INDEXED[0], 64) if size else INDEXED[0], INDEXED[1] if overlap is None else number(overlap, INDEXED[1], 0)


#: Where a text is cut, from coarse to fine: paragraphs, lines, sentences, words.
CUTS = (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r"\s+")


@F.pandas_udf(ArrayType(StringType()))
def _recursive(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    def cut(text: str, size: int, level: int) -> list[str]:
        if len(text.split()) <= size or level == len(CUTS):
            return [text.strip()] if text.strip() else []
        out: list[str] = []
        for part in (p for piece in re.split(CUTS[level], text) for p in cut(piece, size, level + 1)):
            if level and out and len(out[-1].split()) + len(part.split()) <= size:
                out[-1] = f"{out[-1]} {part}"
            else:
                out.append(part)
        return out

    return pd.Series([cut(t, int(n), 0) if t else [] for t, n in zip(texts, sizes)])


def recursive_chunks(text, size: int = INDEXED[0]) -> Column:
    """Chunks of at most `size` words that end at paragraphs, else at lines, sentences or words; parts below a paragraph are put
    together again as far as they fit."""
    return _recursive(col(text), F.lit(size))


@F.pandas_udf(StringType())
def _assigned(pages: pd.Series, names: pd.Series) -> pd.Series:
    def find(page: str | None, name: str):
        m = re.search(re.escape(name) + r"\s*=\s*(?=\{)", page or "")
        try:
            return json.dumps(json.JSONDecoder().raw_decode(page, m.end())[0]) if m else None
        except ValueError:
            return None

    return pd.Series([find(p, n) for p, n in zip(pages, names)])


def assigned(page, name: str) -> Column:
    """The JSON object that a script of the page assigns to a name, or null."""
    return _assigned(col(page), F.lit(name))


def quoted(page, key: str, default: str = "") -> Column:
    """The first "key":"value" of a page."""
    found = F.regexp_extract(F.coalesce(col(page), F.lit("")), f'"{re.escape(key)}":"([^"]+)"', 1)
    return F.when(found != "", found).otherwise(default)


def content_hash(text) -> Column:
    return F.sha1(F.coalesce(col(text), F.lit("")))


def summary(text, n: int = 120) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def terms(text) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def estimate_tokens(text) -> Column:
    n = F.length(F.coalesce(col(text), F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / 4))).cast("long")


def image_tokens(width, height) -> Column:
    w, h = col(width), col(height)
    return F.when(w.isNull() | h.isNull() | (w <= 0) | (h <= 0), 1100).otherwise(F.least(F.lit(1600), F.greatest(F.lit(1), F.ceil(w * h / 750)))).cast("long")


def literal(pattern: str) -> str:
    """A regular expression that matches the string itself."""
    return r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"


def split_text(raw, delimiter: str = "", is_regex: bool = False) -> Column:
    """Pieces without white space at their ends, none of them empty; blank lines part them by default."""
    pattern = r"\n\s*\n"
    if delimiter:
        pattern = literal(delimiter)
        if is_regex:
            try:
                re.compile(delimiter)
                pattern = delimiter
            except re.error:
                pass
    return F.filter(F.transform(F.split(F.coalesce(col(raw), F.lit("")), pattern), strip), lambda x: x != "")


def fill(template, values: dict[str, Column], opening: str = "{", closing: str = "}") -> Column:
    """The template with each {name} replaced by its value (null: nothing). One pass: braces in values stay as they are."""
    parts = F.split(col(template), f"(?={re.escape(opening)})|(?<={re.escape(closing)})")
    keys = {f"{opening}{k}{closing}": F.coalesce(v.cast("string"), F.lit("")) for k, v in values.items()}

    def one(part: Column) -> Column:
        out = part
        for name, value in keys.items():
            out = F.when(part == name, value).otherwise(out)
        return out

    return F.array_join(F.transform(parts, one), "")


def render(template, fields: dict[str, Column]) -> Column:
    """The template with {{ name }} in any case and spacing replaced; the content follows if the template lacks it."""
    parts = F.split(col(template), r"(?=\{\{)|(?<=\}\})")

    def one(part: Column) -> Column:
        name = F.lower(F.regexp_extract(part, r"^\{\{\s*(\w+)\s*\}\}$", 1))
        out = part
        for k, v in fields.items():
            out = F.when(name == k, F.coalesce(v.cast("string"), F.lit(""))).otherwise(out)
        return out

    done = F.array_join(F.transform(parts, one), "")
    has = col(template).rlike(r"(?i)\{\{\s*content\s*\}\}")
    return F.when(has, done).otherwise(F.concat(done, F.lit("\n\n"), F.coalesce(fields["content"], F.lit(""))))


def first_number(text) -> Column:
    return F.expr("try_cast(null as double)") if text is None else F.regexp_extract(col(text).cast("string"), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def strip_reasoning(text) -> Column:
    """Without <think>, <thinking> and <reasoning> blocks, nor what follows one that stays open."""
    closed = F.regexp_replace(col(text), r"(?is)<(think|thinking|reasoning)>.*?</\1>", "")
    return strip(F.regexp_replace(closed, r"(?is)<(think|thinking|reasoning)>.*$", ""))


def data_blocks(text) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?is)<data>(.*?)</data>"), F.lit(1)), strip)


def without_data(text) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?is)<data>.*?</data>", ""))


def punctuation_spacing(text) -> Column:
    return F.regexp_replace(col(text), r"([.,!?;:])(?=\S)", "$1 ")


def clean_transcript(text) -> Column:
    """Without notes, bracketed sounds, (music) and (sound effect); spaces after punctuation; single spaces."""
    bare = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?i)[♪♫]+|\[.*?\]|\(music\)|\(sound effect\)", " ")
    return F.trim(F.regexp_replace(punctuation_spacing(bare), r"\s+", " "))


#: The marks of Markdown that go, in this order, and what stays of them. Links go before images, so an
#: image leaves its exclamation mark.
MARKS = (
    (r"(?s)```.*?```", ""), (r"`([^`]+)`", "$1"), (r"(?m)^#{1,6}\s*", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"(?<!\*)\*([^*]+)\*(?!\*)", "$1"), (r"(?<!_)_([^_]+)_(?!_)", "$1"),
    (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"(?m)^\s*[-*_]{3,}\s*$", ""), (r"\n{3,}", "\n\n"),
)


def strip_markdown(text) -> Column:
    out = col(text)
    for pattern, stays in MARKS:
        out = F.regexp_replace(out, pattern, stays)
    return strip(out)


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    return texts.map(unescape_html, na_action="ignore")


def unescape(text) -> Column:
    """All entities decoded; only texts with an ampersand go to Python."""
    t = col(text)
    return F.coalesce(_decoded(F.when(t.contains("&"), t)), t)


def html_to_text(html) -> Column:
    """Tags out, entities decoded, tags that were written in entities out, white space single."""
    bare = unescape(F.regexp_replace(col(html), TAG, ""))
    return strip(F.regexp_replace(F.regexp_replace(bare, TAG, ""), r"\s+", " "))


#: A tag; marks of no width or of direction; space that stands before punctuation; a line that is an address.
TAG, INVISIBLE, LOOSE, ADDRESS = r"<[^>]+>", r"[\x{200B}\x{200E}\x{200F}\x{FEFF}\x{AD}]", r"\s+([,.;:!?%])", r"^https?://\S+$"
SHORT_LINE = 3


def norm_lines(text) -> Column:
    """Paragraphs of the lines that say something: not too short and more than an address."""
    tidy = lambda line: F.regexp_replace(strip(F.regexp_replace(line, r"[ \t]+", " ")), LOOSE, "$1")
    lines = F.transform(F.split(F.regexp_replace(col(text), INVISIBLE, ""), r"\n"), tidy)
    return F.array_join(F.filter(lines, lambda x: (F.length(x) >= SHORT_LINE) & ~x.rlike(ADDRESS)), "\n\n")


#: What goes from a page before its article is looked for, the article, and what begins or ends a line.
NO_TEXT = r"(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>|<!--.*?-->"
CHROME = r"(?is)<(nav|header|footer|aside|form)\b[^>]*>.*?</\1>"
ARTICLE, LONG_ARTICLE = r"(?is)<(article|main)\b[^>]*>(.*?)</\1>", 500
LINE_TAG = r"(?i)</?(p|div|section|article|h[1-6]|li|tr|br)[^>]*>"


def regex_page_text(html) -> Column:
    """Text of a page by patterns alone: chrome goes first, then the article is taken if it is long enough."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(col(html), F.lit("")), NO_TEXT, " "), CHROME, " ")
    article = F.regexp_extract(bare, ARTICLE, 2)
    body = F.when(F.length(article) > LONG_ARTICLE, article).otherwise(bare)
    return norm_lines(unescape(F.regexp_replace(F.regexp_replace(body, LINE_TAG, "\n"), TAG, " ")))


def page_title(html, fallback=None) -> Column:
    """The first 200 characters of the title, or the fallback where there is none."""
    title = html_to_text(F.regexp_extract(F.coalesce(col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(title != "", F.substring(title, 1, 200)).otherwise(col(fallback) if fallback is not None else F.lit(""))


def fold(term) -> Column:
    """A category for comparing: case folded, & as and, everything else but letters and digits as one space."""
    low = F.replace(F.lower(F.coalesce(col(term), F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.replace(low, F.lit("&"), F.lit(" and ")), r"[^0-9a-z]+", " "))


def defang(text) -> Column:
    """Lines that look like a section mark (two or more = at both ends) get dashes instead."""
    line = lambda x: F.when(x.rlike(r"^\s*={2,}.*={2,}\s*$"), F.translate(x, "=", "-")).otherwise(x)
    return F.array_join(F.transform(F.split(col(text), r"\n"), line), "\n")


def xml_escape(text) -> Column:
    out = F.coalesce(col(text), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xml_legal(text) -> Column:
    return F.regexp_replace(col(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def slug(text, limit: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, limit)


def clipped(text, limit: int, mark: str = "\n[truncated]") -> Column:
    return F.when(F.length(col(text)) > limit, F.concat(F.substring(col(text), 1, limit), F.lit(mark))).otherwise(col(text))


def clock(seconds) -> Column:
    s = col(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60)))


def video_id(url) -> Column:
    """The id of a watch, short, embed or live address; null for others."""
    found = F.regexp_extract(col(url), r"(?i)^(?:https?://)?(?:(?:www|m|music)\.)?(?:youtu\.be/|youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|shorts/|live/|v/))([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.when(found != "", found)


def media_type(data) -> Column:
    """Of a binary column, by its first bytes; empty if unknown."""
    head = F.hex(F.substring(col(data), 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "image/webp").when(F.substring(head, 9, 16).isin("6674797061766966", "6674797061766973"), "image/avif")
        .when(F.substring(head, 9, 8).eqNullSafe("66747970"), "image/heic").when(head.startswith("424D"), "image/bmp").otherwise("")
    )


def score_class(score) -> Column:
    return F.when(col(score) >= 75, "good").when(col(score) >= 50, "ok").otherwise("bad")
