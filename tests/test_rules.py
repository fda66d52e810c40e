import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitegauge.functions.patterns import java, python
from sitegauge.operators import rules

WHOLE = (
    '<!doctype html><html lang="en"><head><title>A title of good length</title>'
    '<meta name="description" content="' + "d" * 100 + '"><meta name="viewport" content="w"><link rel="canonical" href="/">'
    '<meta name="twitter:card" content="s"><script type="application/ld+json">{}</script></head>'
    '<body><header>h</header><nav><ul><li><a href="#main">skip</a></li></ul></nav><main><h1>one</h1><p>text</p></main><footer>f</footer></body></html>'
)


@pytest.fixture(scope="module")
def fired(spark):
    def run(*pages):
        df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "page_id bigint, html string")
        out = [{} for _ in pages]
        for r in rules.findings(df).collect():
            out[r["page_id"]][r["rule_id"]] = r["n"]
        return out

    return run


def test_clean_page_and_null(fired):
    clean, null, empty = fired(WHOLE, None, "")
    assert clean == {}
    assert null == {}
    assert {"L01", "L04", "L05", "S01", "S04", "S07", "S08", "A01", "A02", "M02_main"} <= set(empty)


CASES = [
    ("<h1>a</h1><h1>b</h1>", {"L02": 1, "S10": 1}, ["L01", "S09"]),
    ("<h1>a</h1><h3>b</h3><h5>c</h5><h1>d</h1><h6>e</h6><h1>f</h1><h4>g</h4>", {"L03": 3}, []),
    ("<script><h1>no</h1></script><iframe><h1>no</h1></iframe>", {"L01": 1}, []),
    ('<a href="x">Here</a><a href="y"> read more </a><a href="z">here it is</a>', {"L06": 2}, []),
    ("<a></a><a> </a><a> </a><a></a>", {"L07": 3}, []),
    ('<img src="a"><img src="b" alt=""><img src="c" data-alt="x">', {"L08": 1, "W07": 1, "S12": 1, "A03": 1}, []),
    ('<div onclick="a"></div><div onclick="b" role="button"></div><div onclick="c"></div>', {"L09": 1}, []),
    ("<table><td>1</td></table><table><td>2</td></table><table><thead></thead><td>3</td></table>", {"L10": 1, "L10b": 1, "A11": 1}, []),
    ("<div>" * 6, {"L11": 1}, []),
    ("<div>" * 5, {}, ["L11"]),
    ("<div>" * 20000, {"L11": 1, "M08": 1}, []),
    ('<p id="A"></p><p id="a"></p><p data-id="b"></p><p id="b"></p><p id="c">', {"W02": 2}, []),
    ("<font></font><tt></tt><fonts></fonts>", {"W03": 2}, []),
    ("<a>1</a><a>2</a><a>3</a><a>4</a><a>5</a><a>6</a>", {"W04": 2}, []),
    ("<a><button>x</button></a>", {"W05": 1}, []),
    ("<p>a<div></div><p>b<ul></ul><p>c<h2></h2><p>d<pre></pre>", {"W06": 3}, []),
    ("<main></main><main>x</main>", {"W08": 1, "M03": 1, "M07": 1}, ["L04"]),
    ("<ul><div></div><li></li></ul>", {"W01": 1, "M01": 1}, []),
    ("<ul><li><div></div></li></ul><ol><li><br></li><span></span></ol>", {}, ["W01"]),
    ("<dl><dt>a</dt><p>b</p><p>c</p><i>d</i></dl>", {"W01": 2}, []),
    ('<head><title>short</title><meta name="robots" content="NoIndex"></head>', {"S02": 1, "S13": 1}, ["S01"]),
    ("<head><title>" + "t" * 66 + "</title></head>", {"S03": 1}, ["S02"]),
    ('<head><meta name="description"></head>', {"S05": 1}, ["S04"]),
    ('<head><meta name="description" content="' + "d" * 166 + '"></head>', {"S06": 1}, []),
    ('<p lang="en"></p><p lang="EN"></p><p lang="de"></p>', {"S15": 1}, []),
    ("<section></section><section>x</section><section><h2></h2></section><article>y</article><nav>z</nav>", {"M04": 1, "M04b": 1, "M05": 1, "M06": 1, "M07": 1}, []),
    ('<label for="q">l</label><input id="q"><input id="Q"><input type="hidden"><input aria-label="x">' + "<input>" * 4, {"A04": 3, "A05": 1}, []),
    ('<input placeholder="p"><input type="image" placeholder="p">', {"A04": 1, "A06": 1}, ["A05"]),
    ('<b tabindex="1"></b><b tabindex="0"></b><b tabindex="2"></b><b tabindex="3"></b>', {"A07": 2}, []),
    ('<a target="_blank" rel="noopener"></a><a target="_blank"></a>', {"A08": 1}, []),
    ('<button></button><button aria-label="x"></button>', {"A09": 1}, []),
    ('<a aria-hidden="true">x</a><p aria-hidden="true"></p>', {"A10": 1}, []),
    ("<nav><ul></ul></nav>", {"A12": 1}, ["L05", "M06"]),
]


def test_each_rule(fired):
    for (html, expected, absent), got in zip(CASES, fired(*[c[0] for c in CASES])):
        for rule, n in expected.items():
            assert got.get(rule) == n, (html[:80], rule, got)
        assert not set(absent) & set(got), (html[:80], got)


def test_scores(spark):
    df = spark.createDataFrame([(1, WHOLE), (2, None), (3, "<p>x</p>")], "page_id bigint, html string")
    scores = {(r["page_id"], r["criterion"]): r["score"] for r in rules.criterion_scores(df).collect()}
    assert {p for p, _ in scores} == {1, 3} and all(scores[1, c] == 92 for c in rules.CRITERIA)
    # no first-rank heading, no main (two errors), no menu (one warning)
    assert scores[3, "llm_friendly"] == 92 - 20 - 4
    overall = {r["page_id"]: (r["overall_score"], r["grade"]) for r in rules.overall_scores(df).collect()}
    assert overall[1] == (92, "good")


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, WHOLE, "x", "y")], "page_id bigint, html string, head string, n int_like string".replace("n int_like string", "violations string"))
    assert rules.findings(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=' <>abimgdrulthé="\'/ -_1', max_size=60))
def test_renderings_agree(text):
    for pattern in (rules.P["img"], rules.P["alt"], rules.P["empty_anchor"], rules.P["id"], rules.P["tag"]):
        spelled = java(pattern).replace(r"\x0B", r"\x0b")
        assert [m.group(0) for m in re.finditer(spelled, text)] == [m.group(0) for m in python(pattern).finditer(text)]
