import html
import itertools
import math
import re
from collections import Counter

import pytest

from auxoline.llm import html_extract as H


@pytest.fixture(scope="module")
def pages():
    import duckdb

    return [r[0] for r in duckdb.connect().execute("select html from '/root/testdata/sf0.1/pages.parquet' order by page_id").fetchall()]


@pytest.fixture(scope="module")
def model(pages):
    total = Counter()
    for page in pages[:400]:
        total.update(H.count_page(page))
    return H.TreeModel(total)


def article(page):
    blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_held_out_pages(model, pages):
    wrong = [p for p in pages[400:] if model.text(p) != article(p)]
    assert len(pages) > 1000 and not wrong


PROSE = "This is a long paragraph of main text &amp; more, with enough words to look like prose for a page."


def test_other_layouts(model):
    page = f"<html><body><div class='menu'><a href=x>Home</a></div><div id=content><h1>A title here</h1><p>{PROSE}<p>{PROSE}</div><aside><p>Buy now</p></aside><div class='comments'><p>I like this page a lot and write a long comment about it here.</p></div>"
    text = html.unescape(PROSE)
    assert model.text(page) == f"A title here\n{text}\n{text}"
    page = f"<article><h1>T</h1><p>{PROSE}</p><aside class=notice>note here</aside><form><p>enter mail</p></form><p>More text <a href=x>linked words</a> end.</p><div class='ad'>Buy</div><section class=comments><p>{PROSE}</p></section></article>"
    assert model.text(page) == f"T\n{text}\nMore text linked words end."


def test_broken_markup(model):
    assert model.text("<article><p><b>one two three<br>four <p>five\n six </article><footer>no") == "one two three four\nfive six"
    assert model.text("<article><p>a &lt;b&gt; &am &copy; x<script>var t='</p>'</script> y<!-- c --></p><style>p{}</style><ul><li>the first of two things that are listed here<li>the second of two things that are listed here</ul>") == "a <b> &am © x y\nthe first of two things that are listed here\nthe second of two things that are listed here"
    for page in (None, "", " \n", "<article></article>", "<p", "</p></div>", "<script>never closed", "<title>only a title</title>"):
        assert model.text(page) == ""
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert model.text(deep) in ("", "x")


def test_marginals_are_exact(model):
    tree = H.PageTree("<body><nav><a href=x>m</a></nav><article><h1>head</h1><p>some words here</p><div class=ad><p>buy</p></div></article>")
    nodes = H.nodes_of(tree)
    place = {id(n): i for i, n in enumerate(nodes)}
    weight, content = 0.0, [0.0] * len(nodes)
    assert len(nodes) < 16
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        log = model.first[labels[0]]
        for i, n in enumerate(nodes):
            log += sum(model.emit.get(f, (0.0, 0.0))[labels[i]] for f in H.features(n))
            if i:
                log += model.pair.get(H.pair_kind(n.parent, n), model.pair["any"])[labels[place[id(n.parent)]]][labels[i]]
        weight += math.exp(log)
        for i, y in enumerate(labels):
            content[i] += y * math.exp(log)
    assert model.marginals(nodes) == pytest.approx([c / weight for c in content], abs=1e-9)


def test_query_frame(spark, model):
    rows = [(1, "u", "<article><p>text of it</p></article>", 5), (None, None, None, None), (1, "u", "<article><p>text of it</p></article>", 5), (2, "v", "<article><p>" + "word " * 50_000 + "</p></article>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "text of it", 10)] * 2 + [(None, None, "", 0), (2, "v", ("word " * 50_000).strip(), 249_999)], key=str)
    assert H.extract(pages.limit(0)).count() == 0


def blocks(page):
    return [b.text for b in H.PageTree(page).blocks]


def test_pages_without_head_and_body_tags(model):
    text = html.unescape(PROSE)
    for start in ("<html><head><title>T</title>", "<head><meta charset=x><link rel=y><script>1</script><style>p{}</style><title>T</title><noscript><link rel=z></noscript>", "<title>T</title>", "<head><title>T</title><template><p>no</p></template>"):
        assert model.text(f"{start}<article><p>{PROSE}<p>{PROSE}") == f"{text}\n{text}"
        assert blocks(f"{start}plain text<p>more") == ["plain text", "more"]
    assert blocks("<head><title>T <b>x</b></title></head><body><p>a") == ["a"]
    assert blocks("<head><title>T<body><p>a") == ["a"]


def test_only_scripts_styles_templates_and_titles_are_hidden(model):
    formula = "<math><mi>x</mi><mo>=</mo><mn>1</mn></math>"
    words = "enough words of main text to look like prose on a page about formulas"
    assert model.text(f"<article><p>{words} {formula} and <object>a fallback</object>.</p></article>") == f"{words} x=1 and a fallback."
    assert blocks("<p>a <svg><title>t</title><style>x{}</style><text>b</text><text>c</text></svg> d<select><option>e<option>f</select><noscript>g</noscript><iframe>h</iframe>") == ["a t b c d", "e", "f", "gh"]
    assert blocks("<p>a<template><p>b</p><svg><title>c</title></svg></template><script>d</script><title>e</title>f") == ["a", "f"]


@pytest.mark.parametrize("tags", ["<div>", "<b>", "<p><table><td>", "<ul><li><b>", "<svg><g>", "<button><p>"])
def test_many_unclosed_tags_take_linear_time(tags):
    import time

    began = time.thread_time()
    tree = H.PageTree("<article><p>first</p>" + tags * (200_000 // tags.count("<")) + "last<hr>" * 3 + "</article>")
    assert time.thread_time() - began < 20
    assert tree.blocks[0].text == "first" and tree.blocks[-1].text == "last"


def test_elements_close_as_they_would_by_walking_the_tree():
    """The open elements by tag against a walk to the root, on random tag soup."""
    import random

    rng = random.Random(3)
    tags = ["p", "div", "li", "ul", "table", "tr", "td", "a", "b", "button", "template", "h1", "svg", "option", "section"]

    def walked(tree, tags, stop):
        node, found = tree.at, None
        while node.parent is not None and node.tag not in stop and node.tag != "template":
            found = node if node.tag in tags else found
            node = node.parent
        return found

    class Checked(H.PageTree):
        looks = 0

        def up_to(self, tags, stop):
            got = super().up_to(tags, stop)
            assert got is walked(self, tags, stop)
            Checked.looks += 1
            return got

        def handle_endtag(self, tag):
            path, node = [], self.at
            while node.parent is not None:
                path.append(node)
                node = node.parent
            assert self.path == path[::-1] and all(self.path[d].tag == t for t, ds in self.open.items() for d in ds)
            super().handle_endtag(tag)

    for _ in range(150):
        Checked("".join(rng.choice(["<%s>", "<%s>", "</%s>", "<%s>t "]) % rng.choice(tags) for _ in range(80)))
    assert Checked.looks > 1000
