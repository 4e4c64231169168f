import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from transect.llm import html_blocks as hb


@pytest.fixture(scope="module")
def model():
    return hb.train()


def test_blocks_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
    <body class="x"><!-- <p>not this</p> --><nav><a href="a>b">Home</a> and</nav><p>One <b>t</b>wo &amp; three&nbsp;&#233;<br>four
    <p>five<ul><li>six<li>seven</ul><textarea>no</textarea>tail < end</body></html><div"""
    found = hb.blocks(page)
    assert [b.text for b in found] == ["T", "Home and", "One two & three é", "four", "five", "six", "seven", "tail < end"]
    assert found[1].path == "html/body.x/nav"
    assert found[1].linked == 0.5
    assert [b.path for b in found[4:7]] == ["html/body.x/p", "html/body.x/ul/li", "html/body.x/ul/li"]


def test_blocks_of_broken_pages():
    for page in ("", "<", "<p", "</p></p>", "<!--", "<script>", "plain", "<p title='>x", "<a<b>c", "<p>" * 2000 + "x", "&", "&amp", "x" * 100_000):
        assert all(b.text for b in hb.blocks(page))


@pytest.mark.parametrize("script", ["for(i=0;i<n;i++){}", "if(a<b&&c=='x\"){}", "s='<!-- ';", "s='<b title=\"';", "s='</scripts>'", "s='<script>'"])
def test_scripts_end_at_their_end_tags(script):
    for end in ("</script>", "</SCRIPT >"):
        assert [b.text for b in hb.blocks(f"<p>before</p><script>{script}{end}<p>after</p>")] == ["before", "after"]


def test_only_scripts_styles_templates_and_form_controls_are_dropped():
    page = "<style>a<b{}</style><template><p>no</p></template><select><option>no<option>no</select><textarea><b</textarea>"
    kept = "<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be<noscript><img src='a'></noscript> so</p><noscript><p>one</p></noscript><object>two</object><p><canvas>three</canvas></p><video>four</video><p><audio>five</audio></p>"
    assert [b.text for b in hb.blocks(page + kept)] == ["Let x=1 be so", "one", "two", "three", "four", "five"]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = hb._start(3)
    for group in (model.inputs, model.loops, model.shifts):
        group[:] = [g.astype(np.float64) for g in group]
    model.top, model.bias = model.top.astype(np.float64), model.bias.astype(np.float64)
    x, y = rng.standard_normal((3, 5, hb._INPUT)), rng.integers(0, 2, (3, 5)).astype(float)
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float)
    grads, _ = hb._gradients(model, x, mask, y)
    for p, g in zip(model.parameters(), grads, strict=True):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)]:
            was = p[at]
            p[at] = was + 1e-3
            _, up = hb._gradients(model, x, mask, y)
            p[at] = was - 1e-3
            _, down = hb._gradients(model, x, mask, y)
            p[at] = was
            assert abs((up - down) / 2e-3 - g[at]) < 1e-4


def test_training_lowers_errors_on_unseen_layouts(model):
    right = total = 0
    for page, inside in hb.training_pages(200, 77):
        found = hb.blocks(page)
        paths, rest = hb._features(found, [len(found)])
        right += ((model.chances(paths, rest, np.array([len(found)])) >= 0.5) == inside.astype(bool)).sum()
        total += len(found)
    assert right / total > 0.985


def test_batches_don_t_matter(model):
    pages = [p for p, _ in hb.training_pages(30, 5)] + ["", None]
    assert hb.extract_pages(pages, model) == [hb.extract_pages([p], model)[0] for p in pages]


def article(page):
    """What the driver's pages have in their article element."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"<br>|</?p>|</?h1>", inner)]
    return "\n".join(x for x in lines if x)


def test_driver_pages(spark, small, model):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    found = {r.page_id: r for r in hb.main_text(pages, model).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    assert [r.page_id for r in rows if found[r.page_id].text != article(r.html)] == []
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_a_page_of_another_kind(model):
    page = """<html><body><div class="cookie-notice"><p>We use cookies.</p></div><header><h2>The Site</h2></header><div id="menu"><ul><li><a href="/">Home</a></li></ul></div>
    <main><article class="post"><h1>Title of it</h1><p>First paragraph, of some length, about something.</p><p>Second paragraph, also of some length.</p></article></main>
    <aside class="sidebar"><p>Other stories you may like</p></aside><section class="comments"><div class="comment"><p>Great, thanks!</p></div></section>
    <form><label>Mail</label></form><footer><p>Copyright by the site.</p></footer></body></html>"""
    assert hb.extract_pages([page], model) == ["Title of it\nFirst paragraph, of some length, about something.\nSecond paragraph, also of some length."]


def test_a_page_without_landmarks(model):
    """The paragraphs stay and the comments go; a menu in a cell of a layout table isn't told from text by its place alone."""
    page = """<table class=layout><tr><td><ul><li><a href=/>Home</a></ul></td><td><div id=page><h2>A heading of it</h2><p>First paragraph, of some length, about something.</p>
    <p>Second paragraph, also of some length.</p></div><div class="userComments"><div class=comment><p>Great, thanks!</p></div></div></td></tr></table>"""
    text = hb.extract_pages([page], model)[0]
    assert text.endswith("First paragraph, of some length, about something.\nSecond paragraph, also of some length.")


def test_class_names_end_where_capitals_begin():
    assert hb.blocks("<div class='siteNav mainContent2 XMLbox'>x</div>")[0].path == "div.content.main.nav.site.xmlbox"


def test_deep_nesting_takes_linear_time():
    found = hb.blocks("<nav>" + "<div>text " * 100_000)
    assert len(found) == 100_000
    assert found[0].path == "nav/div" and found[-1].path.count("/") == 100_000
    assert found[3].key == (4 * hb._element_vector("div", False) + hb._element_vector("div", True) + hb._element_vector("nav", False)).tobytes()


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p title=it's>Don't stop here</p><p>second</p>", ["Don't stop here", "second"]),
        ("<p data-x=5' >one</p> <p>it's two</p><p>three</p>", ["one", "it's two", "three"]),
        ("<p x='never closed>one</p><p>two</p>", ["one", "two"]),
        ("<p '>one</p><p \"a>two</p><p =\">three</p>", ["one", "two", "three"]),
        ("<p a='b>c' d=\"e>f\" g = h>ok</p>", ["ok"]),
        ("<p>x<script src='a'/>var a=1;</script>y</p>", ["xy"]),
        ("<p>x<script src=/a/b/>var a=1;</script>y</p>", ["xy"]),
        ("<p>one<style>p{}</style> two<template><p>no</template> three</p>", ["one two three"]),
        ("<div class=a/b/>in<br/>side</div>", ["in", "side"]),
        ("<p>a<!-->b<!--->c<!-- no --!>d<!x>e</%>f", ["abcdef"]),
    ],
)
def test_awkward_markup(page, texts):
    assert [b.text for b in hb.blocks(page)] == texts


def outside_tags(page):
    """Text of a page by single characters, as a state machine reads it."""
    out, at, white = [], 0, " \t\n\f\r"
    while at < len(page):
        rest = page[at:]
        if rest.startswith("<!--"):
            ends = [e for e in (page.find("-->", at + 2), page.find("--!>", at + 4)) if e >= 0]
            if page.startswith("<!-->", at):
                at += 5
            elif not ends:
                return out
            else:
                at = min(ends) + (3 if page.startswith("-->", min(ends)) else 4)
            continue
        if not re.match("<(/?[a-zA-Z])", rest):
            out.append(page[at])
            at += 1
            continue
        at += 2 if rest[1] == "/" else 1
        while page[at] not in white + "/>":
            at += 1
        state, quote = "before", ""
        while True:
            c = page[at]
            if state == "quoted":
                state = "before" if c == quote else state
            elif c == ">":
                break
            elif state in ("before", "name", "after") and c == "=" and state != "before":
                state = "value"
            elif state == "value" and c in "\"'" and page.find(c, at + 1) >= 0:
                state, quote = "quoted", c
            elif state == "value":
                state = "value" if c in white else "unquoted"
            elif state == "unquoted":
                state = "before" if c in white else state
            elif c in white:
                state = "after" if state in ("name", "after") else state
            elif c == "/":
                state = "before"
            else:
                state = "name"
            at += 1
        at += 1
    return out


def test_no_text_outside_a_tag_is_lost():
    """Generated markup against the state machine. Every tag is closed somewhere, if only at the end."""
    rng = random.Random(9)
    parts = ["<b", "<i ", "</b", "<em\n", ">", ">", ">", "'", '"', "=", "= ", " ", "/", "a", "b=c", "x='y'", 'z="w"', "text", "é", "it's", "<!--", "-->", "< ", "&amp;"]
    for _ in range(30_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) + "-->'>\">end"
        text = "".join("".join(b.text.split()) for b in hb.blocks(page))  # some tags end blocks, and with them white space
        assert text == "".join(html.unescape("".join(outside_tags(page))).split()), page


def test_slices_by_bytes():
    pages = pa.array(["x" * n for n in (10, 3 << 20, 5, 1 << 20, 1 << 20, 1)] + [None, ""])
    assert list(hb._slices(pages)) == [(0, 1), (1, 2), (2, 4), (4, 8)]
    assert list(hb._slices(pages.slice(2, 2))) == [(0, 2)] and list(hb._slices(pa.array([], pa.string()))) == []


def test_nulls_and_empty_tables(spark, model):
    rows = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2), (1, "u", "<article><p>Some text of an article.</p></article>", 3)], "page_id long, url string, html string, text int")
    assert sorted(str(tuple(r)) for r in hb.main_text(rows, model).collect())[1:] == ["(1, None, '', 0)", "(None, 'u', '', 0)"]
    assert hb.main_text(rows.limit(0), model).count() == 0
