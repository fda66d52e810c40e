import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitegauge import sources, streaming
from sitegauge.functions import text
from sitegauge.operators import evaluations as ev
from sitegauge.operators import fragments as fr
from sitegauge.operators import locate, metrics, neighbours, resources, rules, views
from sitegauge.plans.catalogue import QUERIES
from sitegauge.settings import Settings


def test_text_metrics(spark):
    pages = [
        (1, '<p>Hello&nbsp;<b>world</b></p><script>no</script><textarea>{"a": 1}</textarea>'),
        (2, None),
        (3, ""),
        (4, "<p>a &amp;lt;b&amp;gt; &#233;&#x1F600;</p>"),
        (5, '<p>x {"@type": "Thing", "name": "abcdefghi"} y { "b }</p>'),
        (6, '<link rel="stylesheet" href="a"><p style="x">t</p>'),
    ]
    got = {r["page_id"]: r for r in metrics.text_metrics(spark.createDataFrame(pages, "page_id bigint, html string")).collect()}
    assert set(got) == {1, 3, 4, 5, 6}
    assert got[1]["visible_chars"] == len("Hello world")
    assert (got[3]["html_bytes"], got[3]["visible_chars"], got[3]["html_to_text_ratio"]) == (0, 0, 0.0)
    assert got[4]["visible_chars"] == len("a <b> é") + 2
    assert got[5]["visible_chars"] == len('x y "b }')
    assert got[6]["markup_bytes"] == len("   <p >t</p>".replace("   <p", " <p"))


def test_advice_order_and_cap(spark):
    page = "<style>" + "x" * 500 + "</style>" * 1 + '<link rel="stylesheet" href="https://a.example/x.css">' * 6 + "<p>t</p>"
    rows = metrics.size_advice(spark.createDataFrame([(1, page)], "page_id bigint, html string"), "a.example").orderBy("ord").collect()
    assert [r["tactic"] for r in rows] == ["ratio_fine", "inline_css_heavy", "many_style_sheets", "minify"]


def test_segments():
    heavy = "<div>" + '<p class="' + "c" * 400 + '">abcdef</p>' + "</div>"
    light = "<section>" + "word " * 100 + "</section>"
    found = fr.top_segments("<main>" + heavy + light + heavy + "</main>")
    assert found[0][0] == "div" and found[0][1] > 50
    assert [f[0] for f in found].count("div") == 1  # of equal structure only one stays
    assert all(a[5] <= b[4] or b[5] <= a[4] for a in found for b in found if a is not b)
    assert fr.top_segments("<div>" + "x" * 10 + "</div>") == []
    assert fr.top_segments("<div>" * 5000) == []


def test_chunks():
    page = "<html><head><title>t</title></head><body>" + "".join(f"<section><p>{'x' * 300}</p></section>" for _ in range(5)) + "</body></html>"
    assert fr.chunks(page, 10**6) == [page]
    parts = fr.chunks(page, 700)
    assert parts[0].endswith("<!-- chunk:head -->") and all(len(p.encode()) <= 700 + 64 for p in parts)
    assert "".join(p.split("\n<!-- chunk")[0] for p in parts).count("x") == 1500
    one = "<main>" + "ä" * 3000 + "</main>"
    assert all(len(p.encode()) <= 800 + 64 for p in fr.chunks(one, 800))
    assert fr.byte_prefix("äöü", 3) == "ä" and fr.slices("äöü", 1) == [] and fr.slices("äöüx", 4) == ["äö", "üx"]
    marked = fr.Markup("</b><p>a</p><p>b</p><br><i></i>")
    assert marked.siblings(0, 31) == [12, 20, 24] and marked.siblings(4, 12) == [] and marked.inside(4, 12) == (7, 8) and marked.inside(20, 24) is None
    deep = "<div>" * 3000 + "x" * 500 + "</div>" * 3000
    assert "".join(fr.divide(fr.Markup(deep), 0, len(deep), 200)) == deep
    short, cut = fr.capped("<head>h</head>" + "b" * 500, 100)
    assert cut and short.startswith("<head>h</head>b") and len(short) <= 100


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<br>", " ", "\n", "xx", "é", "<main>", "</main>", "<i/>", "<head>", "</head>"]), max_size=40), st.integers(8, 60))
def test_chunks_keep_the_text(parts, most):
    page = "".join(parts)
    joined = re.sub("<!--chunk:[a-z-]+-->", "", "".join("".join(re.sub(r"\n<!-- chunk:[a-z]+-part -->$", "", c) for c in fr.chunks(page, most)).split()))
    assert joined == "".join(page.split())
    assert all(len(c.encode()) <= most + 64 for c in fr.chunks(page, most)) or not page.strip()


def test_evaluations(spark):
    facts = spark.createDataFrame([(1, 1, 1, False), (2, 0, 0, True)], "page_id bigint, h1_count int, main_count int, has_root boolean")
    cases = [
        (1, "Missing <h1> element", "Add one", "", "h1_present"),
        (2, "Missing h1 heading", "Add one", "", "h1_present"),
        (2, "Multiple h1 tags", "Keep one", "", "h1_single"),
        (1, "Missing main landmark", "Add", "", "main_present"),
        (2, "Missing main landmark", "Add", "", None),
        (1, "Add og:title tags", "", "", "sharing_tags"),
        (1, "Consider adding a list", "x", "", "vague"),
        (1, "dl has invalid children", "fix the dl", "<dl><dt>a</dt><dd>b</dd></dl>", "children_fine"),
        (1, "ul has invalid children", "fix the ul", "<ul><p>a</p></ul>", None),
        (1, "dd out of place", "move it", "<dt>a</dt><dd>b</dd>", "list_order"),
        (1, "Deeply nested wrappers", "flatten", '<div id="root">', "root_nesting"),
        (9, "Plain finding", None, None, None),
    ]
    rows = [(i, p, "error", a, b, c) for i, (p, a, b, c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "issue_id bigint, page_id bigint, severity string, issue string, recommendation string, html_snippet string")
    got = {r["issue_id"]: r["drop_reason"] for r in ev.drop_reason(df, facts).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}


def test_wrap_suggestions():
    page = '<main><div id="a" class="x y">1</div></main><div class="x">2</div>'
    assert ev.already_wrapped(page, '<p id="a">', ["main"])
    assert not ev.already_wrapped(page, '<p class="x">', ["main"])
    assert ev.already_wrapped(page, '<div id="a" class="x y">1</div>', ["main", "section"])
    assert not ev.already_wrapped(page, "<i>nowhere</i>", ["main"])
    assert not ev.already_wrapped(None, "x", ["main"]) and not ev.already_wrapped(page, None, ["main"])


def test_merge(spark):
    columns = "issue_id bigint, page_id bigint, criterion string, chunk int, ord int, score int, severity string, issue string, html_snippet string, drop_reason string"
    rows = [
        (1, 1, "seo", 0, 0, 80, "error", "Same text", "a", None),
        (2, 1, "seo", 1, 0, 61, "error", " same TEXT ", "b", None),
        (3, 1, "w3c", 0, 0, 50, "error", "Same text", "a", None),
        (4, 1, "w3c", 0, 1, 10, "error", "Same text", "b", None),
        (5, 2, "seo", 0, 0, 97, "info", "Gone", None, "vague"),
        (6, 3, "seo", 0, 0, None, "info", "No score", None, None),
    ]
    df = spark.createDataFrame(rows, columns)
    kept = {r["issue_id"] for r in ev.merged_findings(df.filter("drop_reason is null")).collect()}
    assert kept == {1, 3, 4, 6}
    scores = {(r["page_id"], r["criterion"]): r["score"] for r in ev.merged_scores(df).collect()}
    assert scores == {(1, "seo"): 71, (1, "w3c"): 50, (2, "seo"): 100, (3, "seo"): None}


def test_resources(spark):
    rows = [
        (1, "https://a/jquery.min.js?v=1", "JS", "x" * 10),
        (1, "https://a/app.js", "js", "/*! lib */aaaa/*! two */bbbb"),
        (1, "https://a/app.js", "js", "/*! lib */aaaa/*! two */bbbb"),
        (1, "https://a/s.css", "css", ".menu-open{a}.ab{b}@font-face{x}"),
        (1, "https://a/n.css", "css", None),
        (1, "https://a/i.png", "img", "zz"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, kind string, content string")
    got = {r["kind"]: r for r in resources.resource_totals(df).collect()}
    assert (got["js"]["n_files"], got["js"]["n_packages"], got["js"]["chars"]) == (2, 1, 10 + 28)
    assert got["js"]["app_chars"] == 28 - len("/*! lib */aaaa/*! two */")
    assert (got["css"]["n_files"], got["css"]["app_chars"]) == (1, 32)
    assert resources.vendor_chars("plain") == 0
    assert resources.at_rule_chars("@keyframes k {0%{a}100%{b}}x@font-face{y}@charset 'u';") == len("@keyframes k {0%{a}100%{b}}") + len("@font-face{y}") + len("@charset 'u';")
    js = "e.classList.add('menu-open');f.className = \"row big-one\";g.setAttribute('class', `wide`);$(h).addClass('extra');k.classList.add('no')"
    row = spark.createDataFrame([(js,)], "js string").select(resources.dynamic_classes(F.col("js")).alias("c")).first()
    assert set(row["c"]) == {"menu-open", "big-one", "wide", "extra"}


def test_union_of_ranges(spark):
    random.seed(3)
    sets = [[(a, a + random.randrange(0, 9)) for a in (random.randrange(60) for _ in range(random.randrange(6)))] for _ in range(60)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id int, r array<struct<start: int, end: int>>")
    for r in df.select("id", resources.covered(F.col("r")).alias("n")).collect():
        assert r["n"] == len({x for a, b in sets[r["id"]] for x in range(a, b)})


def test_unused_styles(spark):
    sheet = ".menu-open{a:b}.other-one{c:d}"
    cov = spark.createDataFrame([(1, "u", sheet, [(0, 15, 1)])], "page_id bigint, url string, text string, ranges array<struct<start: int, end: int, count: int>>")
    js = spark.createDataFrame([(1, "x.classList.add('menu-open'); y = 'other-one'")], "page_id bigint, content string")
    r = resources.unused_styles(cov, js).first()
    rest = len(sheet) - 15
    assert r["unused_chars"] == len(sheet) - 15 - int(rest * (0.5 + 0.5 * 0.3) + 0.5)


def test_locate(spark):
    url = spark.createDataFrame([("https://h.example/en/Foo-Bar/item_1/x",), ("nonsense",), (None,)], "u string")
    got = [r["t"] for r in url.select(locate.path_tokens(F.col("u")).alias("t")).collect()]
    assert got == [["foo-bar", "foobar", "item_1", "item1"], [], []]
    files = spark.createDataFrame(
        [("src/a.js", "import x from './lib/b'\nconst y = require('../top')"), ("src/lib/b.js", "export * from '../c.ts'"), ("src/c.ts", "hero-banner"), ("top/index.js", "id='main-nav'"), ("src/d.js", None)],
        "path string, content string",
    )
    edges = {(r["src"], r["dst"]) for r in locate.import_edges(files).collect()}
    assert edges == {("src/a.js", "src/lib/b.js"), ("src/a.js", "top/index.js"), ("src/lib/b.js", "src/c.ts")}
    reach = {(r["src"], r["dst"]): r["depth"] for r in locate.reachable(locate.import_edges(files)).collect()}
    assert reach["src/a.js", "src/c.ts"] == 2
    needles = spark.createDataFrame([("HERO-banner",), ("main-nav",), ("nowhere",), ("abc",)], "needle string")
    hits = {(r["path"], r["needle"]) for r in locate.files_with_needles(files, needles).collect()}
    assert hits == {("src/c.ts", "HERO-banner"), ("top/index.js", "main-nav")}
    snippet = spark.createDataFrame([('<p id="abcd" class="x wide">Some words here</p>',)], "s string")
    assert snippet.select(locate.snippet_words(F.col("s")).alias("n")).first()["n"] == ["words"]


def save_tables(spark, folder, resources, issues, pages):
    spark.createDataFrame(resources, "page_id bigint, url string, kind string, content string").write.parquet(f"{folder}/page_resources.parquet")
    spark.createDataFrame([(k, p, "seo", "error", s) for k, p, s in issues], "issue_id bigint, page_id bigint, criterion string, severity string, html_snippet string").write.parquet(f"{folder}/model_issues.parquet")
    spark.createDataFrame(pages, "page_id bigint, url string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_files_of_one_name_are_all_searched(spark, tmp_path):
    a, b = "https://a.example/s/main.css", "https://b.example/s/main.css"
    resources = [(1, a, "css", "#first-part{}"), (2, a, "css", "#first-part{}"), (2, a, "css", "#second-part{}"), (3, b, "css", "#third-part{}"), (3, b, "css", None)]
    issues = [(k, 1, f'<p id="{k}"><b class="{c}-part">x</b></p>') for k, c in enumerate(("first", "second", "third"))]
    d = save_tables(spark, tmp_path / "t", resources, issues, [(1, "https://a.example/")])
    got = [(r["issue_id"], r["path"]) for r in QUERIES["snippet_file_candidates"](spark, d).orderBy("issue_id").collect()]
    assert got == [(0, a), (1, a), (2, b)]


def test_address_decides_among_files(spark, tmp_path):
    css = lambda *names: "".join(f".{n}{{top:1px}}" for n in names)
    resources = [
        (1, "https://a.example/lamps/main.css", "css", css("wide-hero", "shared")),
        (1, "https://a.example/about/main.css", "css", css("wide-hero", "narrow")),
        (1, "https://a.example/s/one.js", "js", "q('id=\"nav-main\"');q('/go/to-lamps')"),
        (1, "https://a.example/s/two.js", "js", "q('id=\"nav-main\"', wide-hero, 'data-hook=\"k1\"')"),
        (2, "https://b.example/lamps/x.css", "css", css("level")),
        (2, "https://c.example/lamps/y.css", "css", css("level")),
    ]
    snippets = [
        (1, '<p class="wide-hero">x</p>'),  # the address points at one of three
        (2, '<p class="wide-hero">x</p>'),  # at none: nothing
        (1, '<p class="wide-hero narrow">x</p>'),  # both classes in one file, then the address
        (1, '<p id="nav-main" class="wide-hero">x</p>'),  # the class narrows the files of the id
        (1, '<a href="/go/to-lamps">x</a>'),
        (1, '<p data-hook="k1">x</p>'),
        (1, '<p class="level">x</p>'),  # two level ones
    ]
    issues = [(k, p, s) for k, (p, s) in enumerate(snippets)]
    d = save_tables(spark, tmp_path / "t", resources, issues, [(1, "https://a.example/Lamps/desk"), (2, "https://a.example/zzz")])
    got = [(r["issue_id"], r["path"].split("example/")[1], r["tier"], r["boost"]) for r in QUERIES["snippet_file_candidates"](spark, d).orderBy("issue_id", "rank").collect()]
    assert got == [
        (0, "lamps/main.css", 3, 3),
        (2, "about/main.css", 2, 0),
        (2, "lamps/main.css", 3, 3),
        (3, "s/two.js", 1, 0),
        (3, "lamps/main.css", 3, 3),
        (4, "s/one.js", 4, 0),
        (5, "s/two.js", 4, 0),
        (6, "lamps/x.css", 3, 3),
        (6, "lamps/y.css", 3, 3),
    ]
    needles = locate.search_needles('<h2 id="abc" class="pane x">Extraordinary</h2>')
    assert needles[:3] == ['<h2 id="abc" class="pane x"', "<!doctype html", "<!DOCTYPE html"] and {"abc", "pane", "'pane'", 'className="pane x"', "Extraordinary"} < set(needles)


def test_ranges_merge(spark):
    rows = spark.createDataFrame([("k", 0, 5), ("k", 13, 20), ("k", 15, 16), ("k", 29, 30), ("j", 1, 2)], "key string, begin int, end int")
    assert sorted(tuple(r) for r in locate.merge_ranges(rows, "key").collect()) == [("j", 1, 2), ("k", 0, 20), ("k", 29, 30)]


def test_views(spark):
    issues = spark.createDataFrame([(1, "error", " a ", None, "x"), (1, "error", "a", "", "x"), (1, "error", "a", "b", None)], "page_id bigint, severity string, issue string, recommendation string, html_snippet string")
    assert sorted((r["recommendation"], r["n_issues"], r["n_snippets"]) for r in views.grouped_issues(issues).collect()) == [("", 2, 1), ("b", 1, 0)]
    lines = spark.createDataFrame([(1, "name, \"https://a.example/x\" ,ftp://b"), (2, "'http://c.example',https://a.example/x,http://"), (3, None)], "n int, line string")
    assert [r["url"] for r in views.urls_of_lines(lines, "line", ["n"]).orderBy("n", "_p").collect()] == ["https://a.example/x", "http://c.example"]
    jobs = spark.createDataFrame([("j", 1, 1, "u", "running", None, 0, 1), ("j", 1, 1, "u", "done", None, 0, 2), ("j", 2, 2, "v", "failed", "e", 0, 1), ("j", 3, 3, "w", "running", None, 0, 1)], "job_id string, item_no int, page_id bigint, url string, item_status string, error string, created_at bigint, updated_at bigint")
    r = views.job_progress(jobs).first()
    assert (r["n_items"], r["n_done"], r["n_failed"], r["pct"]) == (3, 1, 1, 67)
    notes = spark.createDataFrame([("a", "m", "2025-01-01T00:00:00Z"), ("b", "m", "junk"), ("c", None, None), ("d", "n", "2025-02-01T00:00:00Z")], "feedback_id string, message string, created_at string")
    assert [r["feedback_id"] for r in views.feedback_listing(notes).collect()] == ["d", "a", "b"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, host string, html string")
    assert metrics.text_metrics(empty).count() == 0 and fr.bloated_segments(empty).count() == 0 and fr.html_chunks(empty).count() == 0
    assert views.fetch_verdicts(empty).count() == 0


def test_stream(spark, tmp_path):
    schema = "page_id bigint, url string, host string, html string, ingested_at timestamp"
    source = str(tmp_path / "in")
    batch = spark.createDataFrame([(1, "u", "h", "<p>a</p>"), (1, "u", "h", "<p>a</p>"), (2, "v", "h", None)], "page_id bigint, url string, host string, html string").withColumn("ingested_at", F.timestamp_seconds(F.lit(1700000000)))
    batch.write.parquet(source)
    for _ in range(2):  # a second run finds nothing new
        streaming.audit_stream(streaming.page_stream(spark, source, schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["page_id"] for r in rows} == {1} and len({r["rule_id"] for r in rows}) == len(rows)


def test_sources(spark, tmp_path):
    (tmp_path / "tree/src/sub").mkdir(parents=True)
    (tmp_path / "tree/node_modules").mkdir()
    for name in ("src/a.js", "src/sub/b.vue", "src/c.txt", "node_modules/d.js"):
        (tmp_path / "tree" / name).write_text(f"content of\n{name}")
    got = {r["path"]: r["content"] for r in sources.source_files(spark, str(tmp_path / "tree")).collect()}
    assert got == {n: f"content of\n{n}" for n in ("src/a.js", "src/sub/b.vue")}
    (tmp_path / "notes.json").write_text('[{"id": "a", "message": "m", "createdAt": "2025"}, {"id": 3}, {"message": "x"}]')
    assert [r["id"] for r in sources.feedback_json(spark, str(tmp_path / "notes.json")).collect()] == ["a"]
    (tmp_path / "bad.json").write_text("not json")
    assert sources.feedback_json(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "list.csv").write_text("https://a.example/1,x\r\n\"https://b.example\"\r\n")
    lines = sources.url_lists(spark, str(tmp_path / "list.csv"))
    assert [r["url"] for r in views.urls_of_lines(lines, "line", ["file", "n"]).orderBy("file", "n").collect()] == ["https://a.example/1", "https://b.example"]


def test_small_helpers(spark):
    head = '<meta name="robots" content="index"><meta name="author">'
    row = spark.createDataFrame([(head,)], "h string").select(*[text.meta_content(F.col("h"), n).alias(n) for n in ("robots", "author", "none")]).first()
    assert tuple(row) == ("index", "", None)
    paths = spark.createDataFrame([("src/App.js",), ("lib/x.js",), ("app.js.map",)], "p string")
    assert [r[0] for r in paths.select(locate.is_skipped(F.col("p"), ["app.js", ""])).collect()] == [True, False, False]
    assert locate.excerpt("abcdefghij" * 20, ["c"], 1, 2, 9) == "bcd\n…\nbcd\n…\nbcd"
    assert locate.excerpt("abc", ["x"]) == ""
    both = spark.createDataFrame([("hello world", ["WORLD"]), (None, None)], "c string, n array<string>")
    assert [r[0] for r in both.select(locate.excerpts("c", "n")).collect()] == ["hello world", None]


def test_final_scores(spark):
    pages = spark.createDataFrame([(1, "<p>"), (2, "<p>"), (3, None)], "page_id bigint, html string")
    merged = spark.createDataFrame([(1, "semantic", 3), (1, "seo", 70), (2, "semantic", 90)], "page_id bigint, criterion string, score int")
    bad = spark.createDataFrame([(1,), (1,), (2,)], "page_id bigint")
    got = {(r["page_id"], r["criterion"]): r["score"] for r in ev.final_scores(merged, pages, bad).collect()}
    assert len(got) == 10 and (got[1, "semantic"], got[2, "semantic"], got[1, "seo"], got[2, "seo"]) == (0, 88, 70, 0)


def test_hourly_stream_drops_what_is_too_late(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    hours = [0, 0, 1, 100, 0, 101]

    def land(rows):
        df = spark.createDataFrame([(i, "u", "h", None, 1_700_000_000 // 3600 * 3600 + h * 3600) for i, h in rows], "page_id bigint, url string, host string, html string, s bigint")
        df.withColumn("ingested_at", F.timestamp_seconds("s")).drop("s").write.mode("append").parquet(source)
        counted = streaming.hourly_arrivals(streaming.page_stream(spark, source))
        counted.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for part in ([0, 1, 2], [3], [4], [5]):
        land([(k, hours[k]) for k in part])
    assert sorted(r["n_pages"] for r in spark.read.parquet(out).collect()) == [1, 2]


PROJECT = {
    "app/routes.js": "import shell from './shell'\nimport other from './other'\nimport view from './view'",
    "app/shell.js": "import card from '../parts/card'",
    "app/other.js": "nothing here",
    "app/view.js": "import head from '../parts/head'",
    "parts/head.js": "import deep from './deep'",
    "parts/deep.js": "className='panel-wide'",
    "parts/card.js": "<div data-slot=\"left\">",
    "parts/lone.js": "panel-wide",
}


def test_surroundings(spark):
    files = spark.createDataFrame(list(PROJECT.items()), "path string, content string")
    edges = locate.import_edges(files)
    assert {r["dst"]: r["importers"] for r in neighbours.importers(edges).collect()}["app/view.js"] == ["app/routes.js"]
    around = {r["path"]: (r["how"], r["via"]) for r in neighbours.surroundings(edges).filter("start = 'app/view.js'").collect()}
    assert around == {
        "parts/head.js": ("imported", "app/view.js"), "parts/deep.js": ("imported", "app/view.js"), "app/routes.js": ("importer", "app/view.js"),
        "app/shell.js": ("sibling", "app/routes.js"), "app/other.js": ("sibling", "app/routes.js"), "parts/card.js": ("inner", "app/shell.js"),
    }
    issues = spark.createDataFrame([(1, '<p class="panel-wide x" data-slot="LEFT">t</p>'), (2, "<p>t</p>"), (3, None)], "issue_id bigint, html_snippet string")
    candidates = spark.createDataFrame([(1, "app/view.js", 1), (2, "app/view.js", 1), (3, "app/view.js", 1)], "issue_id bigint, path string, rank int")
    got = sorted(tuple(r) for r in neighbours.expanded_candidates(candidates, issues, edges, files).collect())
    assert got == [(1, "app/view.js", 1, "search", None), (1, "parts/card.js", 3, "inner", "app/shell.js"), (1, "parts/deep.js", 2, "imported", "app/view.js"), (2, "app/view.js", 1, "search", None), (3, "app/view.js", 1, "search", None)]
    assert neighbours.surroundings(edges.filter("false")).count() == 0
    assert neighbours.expanded_candidates(candidates.filter("false"), issues, edges, files).count() == 0


def test_anchors(spark):
    content = "x" * 50 + '<b class="wide"><i class="wide panel extra"><u id="q"><p data-k="v">' + "y" * 2000 + "panel"
    snippet = '<div id="q" class="panel wide" data-k="v">'
    at = content.index
    assert neighbours.class_anchor(content, snippet) == at('class="wide panel')
    assert neighbours.class_anchor(content, "<p>") == -1 and neighbours.class_anchor("", snippet) == -1
    assert neighbours.anchors(content, snippet, "extra") == [at('id="q"'), at('data-k="v"'), at('class="wide panel'), at("extra"), at("panel"), at("wide")]
    assert neighbours.anchors("", snippet) == [] and neighbours.anchors(content, "") == []
    text = neighbours.grounding(content, snippet, at('id="q"'))
    assert text.startswith("/* --- 0 to ") and text.count("/* ---") == 2 and text.endswith("panel")
    assert neighbours.grounding(content, snippet, 0, 10) == ""
    files = spark.createDataFrame([("a.js", "d1", content), ("b.js", "d2", None)], "path string, digest string, content string")
    issues = spark.createDataFrame([(1, snippet), (2, "<p class='none-such'>zz</p>"), (3, None)], "issue_id bigint, html_snippet string")
    candidates = spark.createDataFrame([(1, "a.js", "d1", "extra", 1)], "issue_id bigint, path string, digest string, needle string, rank int")
    placed = neighbours.patch_places(candidates, issues, files).collect()
    assert [(r["issue_id"], r["anchors"][0]) for r in placed] == [(1, at('id="q"'))] and placed[0]["excerpt"] == text
    left = neighbours.unlocated(issues, candidates, files).collect()
    assert {r["issue_id"] for r in left} == {2} and {r["n_files"] for r in left} == {0} and len(left) <= 6


def test_intake_and_settings(spark, tmp_path):
    given = sources.direct_pages(spark, [" <p>a</p> ", " ", None]).collect()
    assert [(r["page_id"], r["html"]) for r in given] == [(0, "<p>a</p>"), (1, None), (2, None)]
    page = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://a", page, 200, "text/html; charset=utf-8"), (2, "http://a", page, 404, "text/html"), (3, "http://a", page, 200, "image/png"), (4, "http://a", page, None, None), (5, "ftp://a", page, 200, "text/html")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, status int, content_type string")
    assert [r["verdict"] for r in views.fetch_verdicts(df).orderBy("page_id").collect()] == ["ok", "bad_status", "not_html", "bad_status", "bad_address"]
    notes = spark.createDataFrame([("a", "m", "2025")], "id string, message string, created_at string")
    for _ in range(2):
        sources.append_notes(notes, str(tmp_path / "notes"))
    assert sources.feedback_json(spark, str(tmp_path / "notes")).count() == 2
    sources.write_reports(rules.reports(df), str(tmp_path / "reports"), 10)
    back = spark.read.json(str(tmp_path / "reports"))
    longest = back.select(F.explode("criteria").alias("c")).select(F.explode("c.issues").alias("i")).agg(F.max(F.length("i.html_snippet"))).first()[0]
    assert back.count() == 5 and longest == 10
    assert Settings.of(spark) == Settings()
    spark.conf.set("spark.sitegauge.targets", '[["^x", "y"]]')
    spark.conf.set("spark.sitegauge.chunk_bytes", "100")
    assert Settings.of(spark) == Settings(targets=(("^x", "y"),), chunk_bytes=100)
    spark.conf.unset("spark.sitegauge.targets")
    spark.conf.unset("spark.sitegauge.chunk_bytes")


def test_views(spark):
    issues = spark.createDataFrame([(1, "error", " a ", None, "s2", 2), (1, "error", "a", "", " s1 ", 1), (1, "error", "a", "", "s2", 3), (1, "error", "a", "", " ", 0), (1, "info", "b", "c", None, 4)], "page_id int, severity string, issue string, recommendation string, html_snippet string, ord int")
    got = {(r["severity"], r["issue"]): (r["first_seen"]["ord"], r["snippets"]) for r in views.grouped_snippets(issues, ["ord"]).collect()}
    assert got == {("error", "a"): (0, ["s1", "s2"]), ("info", "b"): (4, [])}
    rows = spark.createDataFrame([("u", 5), ("u", 9), (None, 1), (None, 2), ("https://h/x/", 3)], "url string, n int")
    assert sorted(r["n"] for r in views.first_per_url(rows, F.desc("n")).collect()) == [1, 2, 3, 9]
    labels = spark.createDataFrame([("https://h/a/b.js?x=/y",), ("https://h/x/",)], "u string")
    assert [r[0] for r in labels.select(views.file_label(F.col("u"))).collect()] == ["b.js", "https://h/x/"]
    assert [r[0] for r in labels.select(views.file_slug(F.col("u"))).collect()] == ["h_a_b.js_x__y", "h_x_"]


def test_merged_report(spark):
    pages = spark.createDataFrame([(1, "<ul><div>a</div><p>b</p></ul>"), (2, "<p>x</p>"), (3, None)], "page_id bigint, html string")
    said = "element not allowed as direct child: div in ul"
    rows = [(10, 1, "semantic", 0, 0, "error", said, "r", "<ul><div>a</div><p>b</p></ul>", None), (11, 1, "semantic", 0, 1, "info", "other", "r", "s", None), (12, 1, "seo", 0, 0, "info", "gone", "r", "s", "vague")]
    df = spark.createDataFrame(rows, "issue_id bigint, page_id bigint, criterion string, chunk int, ord int, severity string, issue string, recommendation string, html_snippet string, drop_reason string")
    got = sorted((r["page_id"], r["criterion"], r["rank"], r["origin"], r["issue"]) for r in ev.merged_report(df, pages).collect())
    assert got[:3] == [(1, "semantic", 1, "rules", "element not allowed as direct child: p in ul"), (1, "semantic", 2, "model", said), (1, "semantic", 3, "model", "other")]
    assert [g[:4] for g in got[3:]] == [(2, c, 1, "none") for c in sorted(ev.CAPS)]
    sizes = ev.doc_size(spark.createDataFrame([(1, 2, "later"), (1, 1, " "), (1, 1, "first")], "page_id bigint, chunk int, recommendation string"), pages)
    assert sorted((r["page_id"], r["recommendation"]) for r in sizes.collect()) == [(1, "first"), (2, None)]
