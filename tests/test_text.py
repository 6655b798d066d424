"""Cleaning rules against the same rules written with Python's regex module."""

import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.functions import html as hx
from lexmill.operators import ngrams
from lexmill.operators import pages as pg

EDGE = [
    "", " ", "plain", "NASA and ÉCOLE and A BC D1 AB_CD", "BÓI!! NÉLL", "a (see q.v. this) b (cf. that) (no)",
    "nested (a (cf. b) c) d", "‹x› «y» “curly” ‘single’ `tick` ′prime´", "dash ‒ – — ― end",
    "space , before . punct ! ? : ; ) and ( inside )", "tab\tand\rcr\x0bvt", "zero​width﻿bom‏mark",
    "line one \n   line two   \n\n\n\nline three\n", "  leading and trailing  ", "ﬁ ½ ² ª ① ﷺ", "naïve café Ångström",
    " line sep para", "x\x1cy\x1dz\x85w", "multi   spaces nbsp　ideographic",
    "emoji 😀 and flags 🇩🇪", "combining é ö", "ends with space before newline \n next", "\n\n\n", "(  )",
    "ΑΒΓ ДЕЖ ÀÉ", "a‍B AB‍CD",
]


def reference_clean(s, nfkd=True):
    if nfkd:
        s = unicodedata.normalize("NFKD", s)
    s = regex.sub(r"\b\p{Lu}{2,}\b", lambda m: m[0].title(), s)
    for pattern, to in (
        (r"[^\p{L}\p{N}\p{Z}\p{P}\p{S}\n]", ""), (r"[​-‏﻿\p{Z}]", " "), ("[‹›«»]", '"'),
        ("[`′´]", "'"), (r"\([^)]*(?:q\.v\.|cf\.)[^)]*\)", ""), ("[‒–—―]", "-"), (r"\s*([,.!?:;)])", r"\1"),
        (r"(\()\s*|\s*(\))", r"\1\2"),
    ):
        s = regex.sub(pattern, to, s)
    s = regex.sub(r"^ +| +$|[^\S\n]+", " ", s, flags=regex.MULTILINE)
    return regex.sub(r"\n{3,}", "\n\n", s).strip()


def apply(spark, fn, values=EDGE):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.select("i", fn(F.col("s")).alias("r")).orderBy("i").select("r").collect()]


def test_clean_text(spark):
    assert apply(spark, tx.clean_text) == [reference_clean(s) for s in EDGE]


def test_clean_patterns_without_decomposition(spark):
    assert apply(spark, tx.clean_patterns) == [reference_clean(s, nfkd=False) for s in EDGE]


def test_curly_option(spark):
    assert apply(spark, lambda c: tx.clean_text(c, curly=True), ["“a” ‘b’"]) == ['"a" \'b\'']


def test_strip_words_and_counts(spark):
    assert apply(spark, tx.strip) == [s.strip() for s in EDGE]
    assert apply(spark, tx.words) == [s.split() for s in EDGE]
    assert apply(spark, tx.count_words) == [len(s.split()) for s in EDGE]


def test_normal_forms(spark):
    assert apply(spark, tx.normalize_nfkd) == [unicodedata.normalize("NFKD", s) for s in EDGE]
    assert apply(spark, tx.normalize_nfkc) == [unicodedata.normalize("NFKC", s) for s in EDGE]


def test_whole_documents_match(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    rows = docs.select("text", tx.clean_text(F.col("text")).alias("c")).collect()
    assert [r["c"] for r in rows] == [reference_clean(r["text"]) for r in rows]


def test_header_and_numbers(spark):
    values = ["head​ body ", " none ", "a​b​c"]
    assert apply(spark, tx.remove_header, values) == ["​ body", "none", "​b​c"]
    assert apply(spark, tx.first_number, ["vol_07_x", "none", "_12", "a_b_3"]) == [7, 0, 12, 3]


def test_safe_title(spark):
    values = ["A/B: c-d_e ", "Émile (1)", "??"]
    assert apply(spark, tx.safe_title, values) == ["AB c-d_e", "Émile 1", ""]


@pytest.mark.parametrize(
    "base,href,expected",
    [
        ("https://h.org/wiki/A", "/wiki/B", "https://h.org/wiki/B"),
        ("https://h.org/wiki/A", "//x.org/y", "https://x.org/y"),
        ("https://h.org/wiki/A", "http://z.org/", "http://z.org/"),
        ("https://h.org/wiki/A?q=1#t", "C", "https://h.org/wiki/C"),
        ("https://h.org", "C", "https://h.org/C"),
        ("https://h.org/a/b?q=1", "?p=2", "https://h.org/a/b?p=2"),
        ("https://h.org/a#x", "#y", "https://h.org/a#y"),
    ],
)
def test_resolve_url(spark, base, href, expected):
    df = spark.createDataFrame([(base, href)], "b string, h string")
    assert df.select(hx.resolve_url(F.col("b"), F.col("h"))).first()[0] == expected


def test_character_references(spark):
    values = ["a &amp;lt; b", "&#233;&#xE9;&eacute;", "&unknown; & plain", "&nbsp;x", "&#128512;"]
    assert apply(spark, hx.decode_references, values) == ["a &lt; b", "ééé", "&unknown; & plain", "\xa0x", "😀"]


def test_nested_container(spark):
    page = (
        '<body><div id="x">no</div><div class="a mw-parser-output b"><p>One <div>two</div></p><!-- <div> -->'
        '<script>var a = "<p>";</script>three</div><div>after</div></body>'
    )
    from lexmill.operators import pages as pg

    df = spark.createDataFrame([(1, "https://h.org/wiki/A", page), (2, "u", "<p>none</p>")], "page_id int, url string, html string")
    rows = pg.extract_article(df).collect()
    assert [(r["page_id"], r["title"], r["content"]) for r in rows] == [(1, "", "One\ntwo\nthree")]


def test_links_keep_order_and_skip_namespaces(spark):
    from lexmill.operators import pages as pg

    page = (
        '<div class="mw-parser-output"><a href="/wiki/B">b</a><a class=x href="/wiki/File:c">c</a>'
        '<a href="/other">o</a><a href="/wiki/B">b</a><a href="https://e.org/wiki/D">d</a></div><a href="/wiki/Z">z</a>'
    )
    df = spark.createDataFrame([(1, "https://h.org/wiki/A", page)], "page_id int, url string, html string")
    links = [r["link"] for r in pg.extract_links(df).orderBy("link_no").collect()]
    assert links == ["https://h.org/wiki/B", "https://h.org/wiki/B", "https://e.org/wiki/D"]


def test_body_and_index_pages(spark):
    from lexmill.operators import pages as pg

    values = ["", "a Volume b", "a Volume b Volume c", "a Volume b Volume c — d — e Volume f"]
    assert apply(spark, pg.extract_body, values) == ["", "", "c", "d — e"]


def test_not_found_message_through_inline_tags(spark):
    rows = [(1, "<p>does not have a <a>text</a> with this name</p>"), (2, "<p>fine</p>"), (3, ""), (4, None), (5, "<!-- does not have a text with this name --><p>x</p>")]
    df = spark.createDataFrame(rows, "page_id int, html string")
    assert sorted(r["page_id"] for r in pg.drop_missing_pages(df, "does not have a text with this").collect()) == [2, 5]


def test_href_forms_and_relative_links(spark):
    from urllib.parse import urljoin

    html = """<a href="/wiki/O'Brien">a</a><a data-href="/bad" href='../d/./e'>b</a><a href=/wiki/X>c</a><a title="q>r" href = "?q=1">d</a><a name=x>e</a>"""
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(hx.hrefs(F.col("h"))).first()[0] == ["/wiki/O'Brien", "../d/./e", "/wiki/X", "?q=1"]
    base = "http://h.org/a/b/c.html"
    links = ["../../../x", "./", "..", "a/../b?x=../y", "/p/../q", "#f", "?z", "http://o/k", "//o/k", "plain"]
    got = spark.createDataFrame([(x,) for x in links], "h string").select("h", hx.resolve_url(F.lit(base), F.col("h")).alias("u")).collect()
    assert {r["h"]: r["u"] for r in got} == {x: urljoin(base, x) for x in links}


def test_character_references(spark):
    df = spark.createDataFrame([("&apos;&amp;&hellip;&#39;&#x1F600;&nosuch;",)], "h string")
    assert df.select(hx.decode_references(F.col("h"))).first()[0] == "'&…'😀&nosuch;"


def test_container_of_many_nested_tags(spark):
    html = "<main>" + "<div>" * 6000 + "x" + "</div>" * 6000 + "</main>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(F.length(hx.container(F.col("h"), "div"))).first()[0] == 5999 * 11 + 1


def test_sentence_ends_with_closers_and_other_scripts(spark):
    text = 'He said "stop." Then (he left.) Good! 三。四！」五 क। ख'
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = ngrams.sentences(df).orderBy("sent_no").collect()
    assert [" ".join(r["tokens"]) for r in rows] == ['He said "stop."', "Then (he left.)", "Good!", "三。", "四！」", "五 क।", "ख"]
