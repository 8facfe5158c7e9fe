"""Published transcripts as cues (text, speaker): SRT, WebVTT, podcast JSON, timed-text JSON, HTML and plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.text import clean_transcript, col, html_to_text, strip

CUES = "array<struct<text:string,speaker:string>>"
#: Line of times, tags of captions, voice, overrides, tag of any kind, name before a text, blocks that are no cues.
TIMES, CAPTION_TAG, VOICE = r"^\s*[\d:,.]+\s*-->\s*[\d:,.]+", r"(?i)<(\d{2}:\d{2}[:.][\d.]+|/?[cibuv](?:\.[^>]*)?)>", r"(?i)<v(?:\.[^\s>]*)?\s+([^>]+)>"
OVERRIDE, MARKUP, PREFIX, NO_CUE = r"\{\\[^}]*\}", r"</?[a-zA-Z][^>]*>", r"^([A-Z][\w .'&-]{1,40}):\s+", r"^(NOTE|STYLE|REGION)"
#: Names that must occur before a text for any of them to be speakers; how far a plain text is searched for times.
NAMES, HEAD = 3, 4000


def _bare(text: Column) -> Column:
    for pattern in (OVERRIDE, CAPTION_TAG, MARKUP):
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def _cue(text: Column, speaker: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (speaker if speaker is not None else F.lit("")).alias("speaker"))


def _said(cues: Column) -> Column:
    return F.filter(cues, lambda c: F.coalesce(c["text"], F.lit("")) != "")


def _blocks(text: Column) -> Column:
    """Arrays of the lines of each block that are not blank."""
    return F.transform(F.split(text, r"\r?\n\s*\r?\n"), lambda b: F.filter(F.split(b, r"\r?\n|\r"), lambda x: strip(x) != ""))


def srt(text: Column) -> Column:
    """Numbers and times of the blocks go."""
    numbered = lambda b: F.when(F.get(b, F.lit(0)).rlike(r"^\s*\d+\s*$"), F.slice(b, 2, F.greatest(F.size(b), F.lit(1)))).otherwise(b)
    lines = F.transform(_blocks(text), lambda b: F.filter(numbered(b), lambda x: ~x.rlike(TIMES)))
    return _said(F.transform(lines, lambda b: _cue(_bare(F.array_join(b, " ")))))


def vtt(text: Column) -> Column:
    """Blocks with a line of times; what follows it is the cue, a voice tag its speaker."""
    body = F.regexp_replace(text, r"^\s*WEBVTT[^\n]*\n", "")
    at = lambda b: F.array_position(F.transform(b, lambda x: x.contains("-->")), True)
    timed = F.filter(_blocks(body), lambda b: (F.size(b) > 0) & ~F.upper(strip(F.get(b, F.lit(0)))).rlike(NO_CUE) & (at(b) > 0))
    said = F.transform(timed, lambda b: F.array_join(F.filter(b, lambda x, k: k >= at(b)), " "))
    return _said(F.transform(said, lambda x: _cue(_bare(x), strip(F.regexp_extract(x, VOICE, 1)))))


def podcast_json(text: Column) -> Column:
    """Segments (body or text, speaker) of a JSON transcript; none if it is no such object."""
    found = F.from_json(text, "segments array<struct<body:string,text:string,speaker:string>>")["segments"]
    first = lambda s: F.when(F.coalesce(strip(s["body"]), F.lit("")) != "", strip(s["body"])).otherwise(strip(s["text"]))
    return F.coalesce(_said(F.transform(found, lambda s: _cue(first(s), F.coalesce(strip(s["speaker"]), F.lit(""))))), F.array().cast(CUES))


def plain(text: Column) -> Column:
    """A cue for each line that is not blank."""
    return _said(F.transform(F.split(text, r"\r?\n|\r"), lambda x: _cue(strip(x))))


def cues(text, kind: Column | str | None = None) -> Column:
    """Cues of a transcript by its media type; text of no known type that has times near its start is read as SRT."""
    t = F.coalesce(col(text), F.lit(""))
    kind = F.lower(F.coalesce(col(kind), F.lit(""))) if kind is not None else F.lit("")
    guessed = F.when(F.substring(t, 1, HEAD).contains("-->"), srt(t)).otherwise(plain(t))
    return (
        F.when(kind == "application/json", podcast_json(t)).when(kind == "text/vtt", vtt(t)).when(kind.isin("application/srt", "text/srt", "application/x-subrip"), srt(t))
        .when(kind == "text/html", plain(html_to_text(t))).otherwise(guessed)
    )


def with_speakers(found: Column) -> Column:
    """Names before a text become speakers if at least NAMES different ones occur: one line that begins "Note:" is no speaker."""
    name = lambda c: F.regexp_extract(c["text"], PREFIX, 1)
    known = F.size(F.array_distinct(F.filter(F.transform(found, name), lambda n: n != ""))) >= NAMES
    promoted = F.transform(found, lambda c: F.when(name(c) != "", _cue(F.regexp_replace(c["text"], PREFIX, ""), name(c))).otherwise(c))
    return F.when(known, promoted).otherwise(found)


def timed_text(payload) -> Column:
    """Events of timed-text JSON as one paragraph."""
    events = F.from_json(col(payload), "events array<struct<segs:array<struct<utf8:string>>>>")["events"]
    said = F.transform(F.filter(events, lambda e: e["segs"].isNotNull()), lambda e: strip(F.array_join(F.transform(e["segs"], lambda s: F.coalesce(s["utf8"], F.lit(""))), " ")))
    return clean_transcript(F.array_join(F.filter(said, lambda x: x != ""), " "))
