"""HTML extraction: small pages, held-out labelled pages, and the given pages against their article's text."""

import html
import os
import re

import duckdb
import pytest

from lamella.llm import html_text

LONG = "Some words that make up a paragraph which goes on long enough to be one, with commas and a full stop at its end."
HTML = [
    (f"<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{LONG}<p>Be <b>bo</b>ld.<br>Line</p></article><footer>F</footer>", f"T & U {LONG} Be bold. Line"),
    (f"<article><h1>T</h1><p>{LONG}</p><div class='ad'>Buy</div><script>var x='<p>no</p>'</script><p>Yes.</p><section class=comments><p>{LONG}</p></section>", f"T {LONG} Yes."),
    (f"<!-- <article>x</article> --><header>Site</header><main><p>a  &lt;b&gt;\n c</p><aside>{LONG}</aside></main>", "a <b> c"),
    (f"<div><a href=x>Home</a></div><div><p>{LONG}</p><p>Short.</p><p>{LONG}<p>Last.</div><div>foot</div>", f"{LONG} Short. {LONG} Last."),
    (f"<article><p>Look <video src=x>{LONG}<p>Yes.</article>", f"Look {LONG} Yes."),
    (f"<article><h1>T</h1><p>{LONG} <a href=x>see here</a> and <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p></article>", f"T {LONG} see here and x=1."),
    (f"<body class='has-sidebar no-ads'><h1>T</h1><p>{LONG}</p><form>Your name<textarea>none</textarea></form><p>{LONG}</p></body>", f"T {LONG} {LONG}"),
    (f"<article><h1>T</h1><p>{LONG}</p><script>var open; <p>{LONG}</p></article>", f"T {LONG} {LONG}"),
    ("", ""), (None, ""), ("<div></div>", ""), ("<article><p>cut of", "cut of"), ("<article><p>x</p></article", "x"),
]
DATA = "/root/testdata/sf0.001/pages.parquet"


def test_pages(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"u{i}", i, i, h) for i, (h, _) in enumerate(HTML)], "page_id long, url string, text long, c0 long, html string")
    out = html_text.extract(df)
    assert out.columns == ["c0", "c1", "c2", "c3", "text"]
    rows = out.collect()
    assert {x[0]: x[4] for x in rows} == {i: t for i, (_, t) in enumerate(HTML)}
    assert all(x[1] == (None if x[0] % 2 else f"u{x[0]}") and x[2] == x[3] == x[0] for x in rows)
    assert html_text.extract(df.limit(0)).collect() == []
    assert len(html_text.extract(df.union(df)).collect()) == 2 * len(HTML)


def test_long_page():
    tree = html_text.train()
    assert html_text.main_text("<article>" + "<p>word</p>" * 20_000 + "</article>", tree) == " ".join(["word"] * 20_000)
    assert html_text.main_text("<div>" * 30_000 + f"<p>{LONG}", tree) == LONG
    assert html_text.main_text("<script>" * 3_000 + f"<p>{LONG}", tree) == LONG


def test_tree_uses_the_text_features_and_holds_on_other_pages():
    tree = html_text.train()
    used, todo = set(), [tree]
    while todo:
        if (node := todo.pop()).feature >= 0:
            used.add(html_text.FEATURES[node.feature])
            todo += [node.low, node.high]
    assert used & {"density", "density_before", "density_after", "container_density"}
    assert used & {"words_before", "words_after"}
    wrong = total = 0
    for page, labels in html_text.labelled_pages(300, seed=99):
        blocks = html_text.blocks_of(page)
        found = html_text.is_main(tree, html_text.features_of(blocks)).tolist()
        wrong += sum(a != b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.01


def article(page: str) -> str:
    """The given pages' articles hold h1, p, b and br only."""
    own = page[page.index("<article>") + 9 : page.rindex("</article>")]
    own = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", own))
    return re.sub(r"\s+", " ", html.unescape(own)).strip()


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables here")
def test_given_pages_with_and_without_their_names():
    tree = html_text.train()
    for (page,) in duckdb.sql(f"SELECT html FROM '{DATA}'").fetchall():
        expected = article(page)
        assert html_text.main_text(page, tree) == expected
        bare = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page).replace(' class="ad"', "")
        assert html_text.main_text(bare, tree) == expected
