import html
import json
import re

import pytest
from pyspark.sql import functions as F

from tessel.functions import captions, pages
from tessel.functions import text as T
from tessel.operators import answers, retrieval
from tessel.plans import registry
from tessel.sources import files
from tests import oracle


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_by_patterns(spark):
    """Hand-made pages with the text and the title that they must give."""
    paragraph = "Long & true, text."
    pages_ = {
        "<nav>menu</nav><TITLE> A &eacute;&#8364;&#x41; &lt;b&gt;x&lt;/b&gt; \n</title><header>h</header><article><header>inner</header>" + "<p>Long &amp; true , text . </p>" * 40 + "<p>https://x.y/z</p><footer>f</footer></article><form>q</form>": ("A é€A x", "\n\n".join([paragraph] * 40)),
        "<script>var p = '<p>no</p>'</script><p>One line</p><!-- <p>not this</p> --><div>an other<br>and more</div>": ("", "One line\n\nan other\n\nand more"),
        "<p>a</p><p>bcd\u200b\u00ad</p>": ("", "bcd"), "": ("", ""),
    }
    df = spark.createDataFrame(list(enumerate([*pages_, None])), "k int, html string")
    got = {r.k: (r.title, r.text) for r in df.select("k", T.page_title("html").alias("title"), T.regex_page_text("html").alias("text")).collect()}
    assert [got[k] for k in range(len(pages_))] == list(pages_.values()) and got[len(pages_)] == ("", "")


@pytest.mark.skipif(not oracle.available(), reason="the driver's tables are not here")
def test_pages_of_the_table(spark):
    """Every page gives a text without marks, and every word of it is a word of the page."""
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{oracle.SF}/pages.parquet").select("page_id", "html").collect()}
    found = {r.page_id: r.text for r in registry.QUERIES["page_text"](spark, oracle.SF).collect()}
    assert found.keys() == rows.keys() and sum(len(t) > 0 for t in found.values()) > len(rows) / 2
    for k, text in found.items():
        page = html.unescape(rows[k] or "")
        assert "<" not in text or "<" in html.unescape(re.sub("<[^>]*>", "", rows[k]))
        assert all(w.strip(",.;:!?%") in page for w in text.split())


def test_unclosed_tags(spark):
    """Paragraphs, items, cells and terms end where the next begins, however many, however deep, and broken pages break no job."""
    both = lambda h: pages.blocks_of(h)[0].split("\n")
    assert both("<p>one<p>two<div>three</div><p>four") == ["one", "two", "four"]
    assert both("<ul><li>a<li>b <ul><li>c<li>d</ul><li>e</ul>") == ["a", "b c d", "c", "d", "e"]
    assert both("<dl><dt>x<dd>y<p>z<dt>w</dl><h2>t<h3>u") == ["x", "y z", "w", "t", "u"]
    assert both("<p>a<button><p>not here</button>b</p>c</p></b><p>d") == ["a b", "d"]
    n = 100_000
    assert both("<p>some words" * n) == ["some words"] * n
    assert pages.blocks_of("<div>" * n + "deep" + "</b>" * n)[1] == "deep" and both("<ul><li>x" * n)[0].count("x") == n
    assert len(pages.blocks_of("<ul><li>x" * n)[0]) < 40 * n
    odd = ["<![if x]><p>a", "<p>a<!", "<p a='", "<![CDATA[x", "<!DOCTYPE [<!ENTITY", "\x00<p>\x00", "<a" * 999]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(odd)], "k int, html string")
    assert df.select(pages.page_text("html").alias("t")).where("t is not null").count() == len(odd)


def test_blocks_without_chrome_and_last_sections(spark):
    prose = "Words that say something about the matter at hand. " * 12
    page = f"""<html><body class="header-x"><div class="site-nav">go</div><main id="share-me"><h1>Head</h1><p>{prose}<a>link</a> on</p><ul><li>one <p>inner</p></li></ul>
    <div role="navigation">nav</div><table><tr><td>cell</td></tr></table><blockquote><p>said</p></blockquote><h2>Sub</h2><p>Kept words here<h2>See also[edit]</h2><p>gone</p><ul><li>gone too</li></ul><h3>deeper</h3><p>gone as well</p>
    <h2>After</h2><p>back again</p><section><h2>References</h2><p>ref</p></section><sup class="reference">[1]</sup></main><script>var x = "<p>no</p>"</script></body></html>"""
    got = one(spark, pages.page_text(F.lit(page)))
    assert got.split("\n\n") == ["Head", (prose + "link on").strip(), "one inner", "said", "Sub", "Kept words here", "After", "back again"]
    assert one(spark, pages.page_text(F.lit("<div>thin one</div><div>and thin two &copy;</div>"))).split("\n\n") == ["thin one", "and thin two ©"]
    assert one(spark, pages.page_text(F.lit(None).cast("string"))) == "" and one(spark, pages.page_text(F.lit("</p></b><p>open"))) == "open"


def test_cues(spark):
    said = lambda text, kind: [(c.text, c.speaker) for c in one(spark, captions.cues(F.lit(text), F.lit(kind)))]
    srt = "1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>Hi</i> {\\an8}you\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n\r\n\r\n3\n00:01 --> 00:02\n2001 was it"
    assert said(srt, "application/x-subrip") == said(srt, "text/plain") == [("Hi you there", ""), ("2001 was it", "")]
    vtt = "WEBVTT - x\n\nNOTE nothing --> here\n\nSTYLE\nx\n\nid1\n00:01.000 --> 00:02.000 align:start\n<v.loud Ann Lee>Hello <00:01.500><c.x>you</c></v>\nall\n\nno times\n\n00:03.000 --> 00:04.000\nbye"
    assert said(vtt, "Text/VTT") == [("Hello you\nall".replace("\n", " "), "Ann Lee"), ("bye", "")]
    payload = json.dumps({"segments": [{"body": " a ", "speaker": "S"}, {"text": "b"}, {"body": ""}, {"body": " ", "text": "c"}]})
    assert said(payload, "application/json") == [("a", "S"), ("b", ""), ("c", "")] and said("[1", "application/json") == said("{}", "application/json") == []
    assert said("<p>A &amp; B</p>\n<p>c</p>", "text/html") == [("A & B c", "")] and said(" x \n\n y", None) == [("x", ""), ("y", "")] and said("", None) == []
    names = [("Ann: hi", ""), ("Bob: yes", ""), ("plain", "X"), ("O'Neil & Co: no", "")]
    promote = lambda rows: [(c.text, c.speaker) for c in one(spark, captions.with_speakers(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(s).alias("speaker")) for t, s in rows])))]
    assert promote(names) == [("hi", "Ann"), ("yes", "Bob"), ("plain", "X"), ("no", "O'Neil & Co")] and promote(names[:3]) == names[:3]
    timed = json.dumps({"events": [{"segs": [{"utf8": "one"}, {"utf8": "two.three"}]}, {"x": 1}, {"segs": [{"utf8": " "}]}, {"segs": [{"utf8": "[music] end"}, {}]}]})
    assert one(spark, captions.timed_text(F.lit(timed))) == "one two. three end"


def test_feeds_of_both_kinds(spark, tmp_path):
    rss = """<rss xmlns:podcast="p" xmlns:itunes="i" xmlns:content="c"><channel><title>Show</title>
    <item><guid isPermaLink="false"> g1 </guid><title>One &amp; only</title><link>http://x/1</link><itunes:author>Me</itunes:author><description>short</description><content:encoded>&lt;p&gt;long&lt;/p&gt;</content:encoded><category>A</category><category>B</category>
      <enclosure url="http://x/doc.pdf" type="application/pdf"/><enclosure url="http://x/1.mp3?y=1" type=""/><itunes:duration>10:00</itunes:duration><itunes:episode>4</itunes:episode>
      <podcast:transcript url="http://x/1.srt" type="application/SRT" language="EN"/><podcast:transcript type="x"/><podcast:person role="host" href="h">Ann</podcast:person><podcast:chapters url="http://x/c.json" type="j"/></item>
    <item><title>no identity</title></item><item><enclosure url="http://x/v" type="Video/mp4"/></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><id>e1</id><title>T</title><link href="http://y/1"/><link rel="enclosure" href="http://y/1.ogg" type="audio/ogg"/><author><name>You</name></author><summary>sum</summary><updated>2024-01-01</updated><category term="news"/></entry></feed>"""
    (tmp_path / "a.xml").write_text(rss)
    (tmp_path / "b.xml").write_text(atom)
    got = {r.guid: r for r in files.feed_entries(spark, str(tmp_path)).collect()}
    r = got["g1"]
    assert set(got) == {"g1", "", "e1"} and (r.title, r.link, r.author, r.categories, r.body_html, r.body_source, r.duration, r.episode) == ("One & only", "http://x/1", "Me", ["A", "B"], "<p>long</p>", "content", "10:00", "4")
    assert (r.enclosure_url, [tuple(t) for t in r.transcripts], [tuple(p) for p in r.persons], r.chapters_url) == ("http://x/1.mp3?y=1", [("http://x/1.srt", "application/srt", "", "en")], [("Ann", "host", "", "h")], "http://x/c.json")
    assert (got[""].enclosure_url, got[""].enclosure_type) == ("http://x/v", "video/mp4")
    e = got["e1"]
    assert (e.title, e.link, e.author, e.published, e.categories, e.body_html, e.body_source, e.enclosure_url, e.transcripts) == ("T", "http://y/1", "You", "2024-01-01", ["news"], "sum", "description", "http://y/1.ogg", [])


def test_questions_are_rewritten_and_keep_their_words(spark):
    asked = spark.createDataFrame([(1, "what of it", "User: cats"), (2, "plain", None), (3, " ", None), (4, "broken", ""), (5, "same", "")], "query long, q string, history string")

    def model(prompts):
        out = []
        for p in prompts:
            assert p.endswith("\n\nJSON:") and ("Conversation so far:\nUser: cats" in p) == ("what of it" in p)
            out.append('Sure: ```json\n{"queries": [" cats ", "", 3, "b", "c", "d"], "keywords": ["k ", null]}\n```' if "what of it" in p else '{"queries": ["same"]}' if "same" in p else "no idea" if "broken" in p else None)
        return out

    got = {r["query"]: (r.variants, r.keywords) for r in answers.rewritten(asked, model).collect()}
    assert got == {1: (["cats", "b", "c", "what of it"], ["k"]), 2: (["plain"], []), 3: ([" "], []), 4: (["broken"], []), 5: (["same"], [])}
    fails = {r["query"]: r.variants for r in answers.rewritten(asked, lambda prompts: 1 / 0).collect()}
    assert fails == {k: [q] for k, q in ((1, "what of it"), (2, "plain"), (3, " "), (4, "broken"), (5, "same"))}


def test_history(spark):
    m = [("c", k, "user" if k % 2 == 0 else "assistant", f"t{k}\nx" if k != 3 else "  ", k == 5) for k in range(9)] + [("d", 0, "user", "only", False), ("e", 0, "user", "q", False), ("e", 1, "assistant", "a" * 30, False)]
    df = spark.createDataFrame(m, "chat string, idx int, role string, content string, intermediate boolean")
    got = {r.chat: r.history for r in answers.history(df, 4, 25).collect()}
    want = "\n".join(f"{'User' if k % 2 == 0 else 'Assistant'}: t{k} x" for k in (2, 4, 6, 7))
    assert got == {"c": ("User: t2 x\n" * 0 + want)[-25:], "e": "a" * 25}


def test_degraded_questions_and_blocks(spark):
    asked = spark.createDataFrame([(1, "cat", ["a"]), (2, "dog", ["b"]), (3, "cat", [])], "query long, q string, library_ids array<string>")
    chunks = spark.createDataFrame([("library:a:1:0", "library", "a", "1", 0, "the cat <sat>"), ("library:b:1:0", "library", "b", "1", 0, "dog")], "id string, source_type string, source_id string, item_id string, chunk_index int, content string")
    found = answers.retrieve_for(asked, chunks, spark.createDataFrame([("a", "compiled"), ("b", "stale")], "source_id string, state string"))
    assert [(r["query"], r.id) for r in found.collect()] == [(1, "library:a:1:0")] and sorted(r["query"] for r in answers.degraded(asked, found).collect()) == [2, 3]
    rows = spark.createDataFrame([(1, 0, "chat_thread:c:m3:2", None, "c", "m3", None, '{"label": "Turn 4 \\"x\\"", "index": 3}', -1.0, "a & b"), (1, 1, "free", None, "", "", None, None, 0.5, " t ")], "query long, rank int, id string, source_type string, source_id string, item_id string, chunk_index int, meta string, score double, content string")
    none = spark.createDataFrame([], "item_id string, live_label string"), spark.createDataFrame([], "source_id string, name string")
    described = retrieval.sources(rows, *none)
    assert [(r.kind, r.chunk_index, r.label, r.library_name, r.message_index) for r in described.orderBy("rank").collect()] == [("thread", 2, 'Turn 4 "x"', None, 3), ("inline", None, "excerpt", None, None)]
    assert retrieval.excerpt_block(described).first().block == '<retrieved>\n  <excerpt item="m3" label="Turn 4 &quot;x&quot;">\na &amp; b\n  </excerpt>\n  <excerpt item="excerpt" label="excerpt" score="0.500">\n t \n  </excerpt>\n</retrieved>'
    assert retrieval.excerpts(rows).first().excerpts == "[1] (m3) a & b\n\n[2] () t" and retrieval.excerpts(rows.limit(0)).first().excerpts == "(none found)"


def test_pages_come_to_python_in_small_batches(spark, monkeypatch):
    """Of any number of pages a worker holds a batch of few; before, 10,000 pages were one batch."""
    import pandas as pd
    from pyspark.sql import functions as F

    from tessel.functions import pages

    @F.pandas_udf("struct<blocks:string,all:string>")
    def sizes(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"blocks": [str(len(html)).zfill(500)] * len(html), "all": [""] * len(html)})

    monkeypatch.setattr(pages, "page_blocks", sizes)
    for name, before in (("maxRecordsPerBatch", "10000"), ("maxBytesPerBatch", str(64 << 20))):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", before)
    found = spark.range(0, 1000, 1, 1).select(F.concat(F.lit("<p>x"), "id").alias("html")).select(pages.page_text("html").alias("t")).distinct().collect()
    assert max(int(r.t) for r in found) <= 128
