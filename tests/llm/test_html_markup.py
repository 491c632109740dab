"""HTML extraction: what hides and what does not, broken quotes, parts inside an article."""

import time

import pytest

from lattica.llm import html

STORY = ("A long story, told in full, with a few turns. " * 6).strip()


@pytest.fixture(scope="module")
def trees(spark):
    return html.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), **html.PARAMETERS)


@pytest.mark.parametrize("name", ["overflow-hidden", "overflow-x-hidden", "md:hidden", "hidden", "visually-hidden"])
@pytest.mark.parametrize("place", ["body", "wrapper", "article"])
def test_no_class_hides(trees, name, place):
    at = {p: f' class="{name}"' if p == place else "" for p in ("body", "wrapper", "article")}
    page = f'<html><body{at["body"]}><div{at["wrapper"]}><nav><a href="/">Home</a> <a href="/x">More</a></nav><article{at["article"]}><h1>Title here</h1><p>{STORY}</p><p>{STORY}</p></article><footer>end</footer></div></body></html>'
    assert html.main_text(page, trees) == f"Title here\n{STORY}\n{STORY}"


@pytest.mark.parametrize("mark", ["hidden", 'hidden=""', "HIDDEN", 'aria-hidden="true"', 'style="color:red; display: none"', "style=display:none"])
def test_attributes_hide(mark):
    nodes, stream = html.parse(f"<p>a</p><div {mark}><p>b</p></div><p>c</p>")
    assert [t for n, t in stream if t and not n.hidden] == ["a", "c"]
    assert not any(n.hidden for n in html.parse('<div data-hidden="x" style="display:block" aria-hidden=false class=hidden><p>b</p></div>')[0])


def test_quotes(trees):
    seen = lambda page: [t for _, t in html.parse(page)[1] if t]
    assert seen("<p title=don't>One</p><p>It's two</p><p>three</p>") == ["One", "It's two", "three"]
    assert seen("""<p title="a > b" class='c > "d"'>One</p>""") == ["One"]
    assert seen("<p title=\"never closed>One</p><p>Two</p>") == ["One", "Two"]
    page = f"<body><nav><a title=don't href=/x>menu</a> <a href=/y>more</a></nav><article><p>It's here. {STORY}</p></article></body>"
    assert html.main_text(page, trees) == f"It's here. {STORY}"
    tokens = lambda page: html.parse(page)[0][1].tokens
    assert tokens("<p class=a id='b c' role = \"d\">") == ["a", "b", "c", "d"] and tokens("<p title=x=y class=it's>") == ["it", "s"]


@pytest.mark.parametrize("unit, end", [('<a b="', ""), ('<a b="', ">"), ("<a b='\"", "x>"), ("<!", ""), ("</a ", ""), ("<", ">"), ('<a b="">', ""), ("<a ", "x" * 400_000 + ">"), ('<a b="<a b=', '">')])
def test_broken_markup_takes_linear_time(unit, end):
    began = time.time()
    html.parse(unit * 200_000 + end)
    assert time.time() - began < 5  # minutes to days, if each tag reads on to the end


def test_parts_inside_an_article(trees):
    page = f"<body><article><p>{STORY}</p><aside><p>Related: see also this.</p></aside><p>{STORY}</p><nav><a href=/2>next page</a></nav></article></body>"
    assert html.main_text(page, trees) == f"{STORY}\n{STORY}"
