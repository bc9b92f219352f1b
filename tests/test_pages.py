"""HTML pages and feed payloads of every format."""

import json
import os
import tempfile

from tidings.operators import ingest as I
from tidings.sources.fixtures import ts


def _page(spark, html, url="https://h.example/a/b/page.html?q=1#f"):
    return I.extract_pages(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")).collect()[0]


def test_tags_in_any_case_and_quoting(spark):
    r = _page(spark, "<!doctype html><HTML class=x LANG=en-GB><Title data-a='>'>A &amp;lt; B&#33;&#x41;&quot;</TITLE >"
                     "<A HREF=/one>1</a><a title=\"x href='no'\" href='two'>2</a><a data-href=no href = \"three\" >3</a><a name=href>4</a>"
                     "<link rel=x href=\"/s.css\"><a href>5</a><area href=?p=2><a href='a=b/c?d=e'>6</a>")
    assert (r.title, r.lang, r.host) == ('A &lt; B!A"', "en-GB", "h.example")
    assert r.links == ["https://h.example/one", "https://h.example/a/b/two", "https://h.example/a/b/three", "https://h.example/s.css",
                       "https://h.example/a/b/page.html?q=1", "https://h.example/a/b/page.html?p=2", "https://h.example/a/b/a=b/c?d=e"]
    assert r.n_links == 7


def test_nothing_is_taken_out_of_comments_scripts_and_styles(spark):
    r = _page(spark, "<html><!-- <title>no</title><a href='c'> --><script>var t='<title>no</title><a href=\"s\">';</script ><style>a{}/*<a href=t>*/</style>"
                     "<title>yes</title><a href='ok'>x</a><!-- never closed <a href='d'>")
    assert (r.title, r.lang, r.links) == ("yes", "", ["https://h.example/a/b/ok"])


def test_links_resolve_against_base_and_dots(spark):
    links = ["../up", "./same", "../../../over", "//cdn.example/x", "HTTP://Other/y", "mailto:a@b", "#top", "", " /sp ", "d/./e/../f/..", "?x=1"]
    html = "".join(f'<a href="{x}">' for x in links)
    assert _page(spark, html).links == [
        "https://h.example/a/up", "https://h.example/a/b/same", "https://h.example/over", "https://cdn.example/x", "HTTP://Other/y", "mailto:a@b",
        "https://h.example/a/b/page.html?q=1#top", "https://h.example/a/b/page.html?q=1", "https://h.example/sp", "https://h.example/a/b/d/",
        "https://h.example/a/b/page.html?x=1"]
    assert _page(spark, '<base href="/root/"><a href="x">').links == ["https://h.example/root/x"]
    assert _page(spark, '<base href="https://b.example"><a href="x&amp;y=&#228;">').links == ["https://b.example/x&y=ä"]
    assert _page(spark, '<a href="x">', url=None).links == ["x"]


def test_awkward_pages(spark):
    for html in (None, "", "<", "<a href='never closed", "text < 3 > 2", "<a " + "x='1' " * 3000 + "href=z>", "<title>open", "&#0; &#xD800; <title>&#1114112;&#128512;</title>"):
        r = _page(spark, html)
        assert r.n_links == len(r.links) and r.lang == ""
    assert _page(spark, "<title>&#1114112;&#128512;&nbsp;</title>").title == "&#1114112;😀 "


def test_feeds_of_all_formats_in_one_folder(spark):
    root = tempfile.mkdtemp()
    payloads = {
        "rss.xml": "<?xml version='1.0'?><rss><channel><title>T</title><item><guid>g1</guid><title>a &amp; b</title><link>l1</link>"
                   "<description>d</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><dc:creator>me</dc:creator></item>"
                   "<item><title>cdata</title><link>l2</link><content><![CDATA[ </item> <b>x</b> ]]></content></item></channel></rss>",
        "atom.xml": "<feed><entry><id>e1</id><title>atom</title><link rel='self' href='no'/><link href='l3'/><summary>s</summary>"
                    "<published>2024-01-02T10:00:00Z</published><author><name>N</name></author></entry></feed>",
        "feed.json": json.dumps({"version": "https://jsonfeed.org/version/1", "items": [
            {"id": "j1", "url": "l4", "title": "json", "content_text": "c", "date_published": "2024-01-03T10:00:00Z", "authors": [{"name": "A"}]},
            {"id": "", "external_url": "l5", "summary": "sum", "author": {"name": "B"}}]}, indent=1),
        "junk.txt": "no feed at all <p>", "broken.json": '{"items": [', "empty.xml": "", "other.json": '{"entries": []}',
    }
    os.makedirs(f"{root}/feed=f")
    for name, text in payloads.items():
        with open(f"{root}/feed=f/{name}", "w") as f:
            f.write(text)
    got = {r.guid: r for r in I.read_feed_items(spark, root, ts("2024-01-31 00:00:00")).collect()}
    assert sorted(got) == ["e1", "g1", "j1", "l2", "l5"]
    assert [(got[k].title, got[k].link, got[k].content, got[k].author, str(got[k].published)) for k in ("g1", "e1", "j1")] == [
        ("a & b", "l1", "d", "me", "2024-01-01 10:00:00"), ("atom", "l3", "s", "N", "2024-01-02 10:00:00"),
        ("json", "l4", "c", "A", "2024-01-03 10:00:00")]
    assert got["l2"].content.strip() == "</item> <b>x</b>" and (got["l5"].content, got["l5"].author) == ("sum", "B")
    assert all(r.feed == "f" for r in got.values())
