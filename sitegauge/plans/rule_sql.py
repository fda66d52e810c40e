"""The audit rules once more, as SQL for an engine with linear regular expressions.

Only the patterns and word lists are shared with the Spark rules; counting, capping and
pairing are written here independently, to check them against.
"""

from __future__ import annotations

from sitegauge.functions.patterns import linear as L
from sitegauge.functions.text import INERT
from sitegauge.operators.rules import ALLOWED_CHILDREN, DEPRECATED, GENERIC_ANCHORS, LANDMARKS, PLACEHOLDER_SKIPS, SEMANTIC_TAGS, TEXTS, UNLABELLED_SKIPS, P, open_tag, parent_span

#: Markup with one defect each, for pages that lack them; text only.
DEFECTS = (
    "<h1>a</h1><h1>b</h1><h4>c</h4><h2>d</h2><h6>e</h6><h1>f</h1><h3>g</h3><h1>h</h1><h5>i</h5>",
    '<a href="/x">Click  here</a><a href="/x">click here</a><a href="/y"> more </a><a href="/z">READ MORE</a>',
    '<a href="/1"></a><a href="/2"> </a><a href="/3"></a><a href="/4"></a>',
    '<img src="a"><img src="b" data-alt="x"><img src="c" ALT="">' + '<img src="d">' * 6,
    '<div onclick="a()">x</div><div role="button" onclick="b()">y</div><div onclick="c()">z</div>',
    "<table><tr><td>1</td></tr></table><table><tr><td>2</td></tr></table><table><thead></thead><tr><td>3</td></tr></table><table><tr><th>h</th><td>4</td></tr></table>",
    "<ul><div>a</div><li>b</li><p>c</p></ul><ol><li><br></li><span>x</span></ol><dl><dt>a</dt><div></div><dd>b</dd><b>c</b></dl>",
    "<select><option>1</option><p>2</p></select><tr><div>1</div><td>2</td></tr><tbody><td>x</td><tr></tr></tbody><ul><div>a</div><li>b</li><p>c</p></ul>",
    '<p id="one">a</p><p ID="One">b</p><p id="two">c</p><b data-id="two">d</b><i id="three">e</i>',
    "<font>a</font><center>b</center><marquee>c</marquee><tt>d</tt><big>e</big><frame>",
    '<a href="/p"><button>x</button></a><a href="/q"><button>y</button></a><a href="/r"><button></button></a>',
    "<main>a</main><main>b</main><main></main><section> </section><article></aside><aside></aside>",
    "<section><p>a</p></section><section><p>b</p></section><section><h3>c</h3></section><article><p>d</p></article><article><h2>e</h2></article>",
    "<nav><p>a</p></nav><nav><ul><li>b</li></ul></nav>",
    "<div>" * 60 + "<span>" * 300,
    '<input type="text"><input type="hidden"><input id="q9"><label for="q9">l</label><input aria-label="x"><input placeholder="a"><input TYPE="Submit"><input><input>',
    '<input placeholder="b" id="lone"><input type="image" placeholder="c"><input id="Case"><label for="case">l</label>',
    '<b tabindex="1">a</b><b tabindex="0">b</b><b tabindex="12">c</b><b tabindex="3">d</b>',
    '<a target="_blank" rel="noopener" href="/a">a</a><a target="_blank" href="/b">b</a>',
    '<button></button><button aria-label="x"></button><button> </button><button></button>',
    '<a aria-hidden="true" href="/">a</a><input aria-hidden="true"><select aria-hidden="false"></select>',
    '<a href="#main">skip</a><p lang="fr">x</p><p lang="pt">y</p><p xml:lang="FR">z</p>',
    '<script type="application/ld+json">{}</script><!-- <h1>no</h1> --><template><main></main></template>',
    "",
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def varied_sql() -> str:
    cases = " ".join(f"WHEN {k} THEN {_quoted(x)}" for k, x in enumerate(DEFECTS))
    return f"SELECT page_id, html || CASE page_id % {len(DEFECTS)} {cases} END AS html FROM pages"


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_quoted, names)) + "]"


def _all(key: str, group: int = 0, of: str = "html") -> str:
    return f"regexp_extract_all({of}, {L(P.get(key, key))}, {group})"


def _first(key: str, group: int = 0, of: str = "html") -> str:
    return f"regexp_extract({of}, {L(P.get(key, key))}, {group})"


def _has(key: str, of: str = "html") -> str:
    return f"regexp_matches({of}, {L(P.get(key, key))})"


def _strip(text: str, patterns: tuple[str, ...]) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, {L(p)}, ' ', 'g')"
    return text


_TRIM = L(r"^\s+|\s+$")


def children_cte(source: str = "src") -> str:
    """CTE ``violations(page_id, parent, child, span)``: the walk as window sums over exploded tags."""
    spans = " UNION ALL ".join(
        f"SELECT page_id, '{tag}' AS parent, {_list(allowed)} AS allowed, unnest(regexp_extract_all(html, {L(parent_span(tag))}, 0)) AS span, unnest(regexp_extract_all(html, {L(parent_span(tag))}, 1)) AS inner_html FROM {source}" for tag, allowed in ALLOWED_CHILDREN.items()
    )
    return f"""
spans AS (SELECT row_number() OVER () AS span_id, * FROM ({spans})),
tags AS (
  SELECT span_id, page_id, parent, allowed, span, unnest({_all('tag', 0, 'inner_html')}) AS tag, generate_subscripts({_all('tag', 0, 'inner_html')}, 1) AS pos FROM spans
),
steps AS (
  SELECT *, starts_with(tag, '</') AS closing, lower({_first('tag_name', 1, 'tag')}) AS name,
    CASE WHEN starts_with(tag, '</') THEN -1 WHEN ends_with(tag, '/>') THEN 0 ELSE 1 END AS step FROM tags
),
sums AS (SELECT *, sum(step) OVER (PARTITION BY span_id ORDER BY pos) AS total FROM steps),
floors AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY span_id ORDER BY pos)) AS depth FROM sums),
walked AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY span_id ORDER BY pos) AS before FROM floors),
violations AS (
  SELECT page_id, parent, name AS child, substring(arg_min(flat, span_id), 1, 400) AS span
  FROM (SELECT *, regexp_replace(span, {L(chr(92) + 's+')}, ' ', 'g') AS flat FROM walked WHERE NOT closing AND before = 0 AND NOT list_contains(allowed, name))
  GROUP BY page_id, parent, name, substring(flat, 1, 300)
)"""


def _short(text: str, most: int = 300) -> str:
    return f"CASE WHEN length({text}) > {most} THEN substring({text}, 1, {most}) || '…' ELSE {text} END"


def _shorts(texts: str, most: int = 300) -> str:
    return f"list_transform({texts}, lambda s: {_short('s', most)})"


def _when(condition: str, snippet: str) -> str:
    return f"list_filter([CASE WHEN {condition} THEN {snippet} END], lambda s: s IS NOT NULL)"


def _snippets() -> list[tuple[str, str, str, str]]:
    """``(criterion, rule_id, severity, list of snippets)`` of every rule, over the columns of ``_facts_sql``."""
    b = chr(92)
    cut, gone = _quoted("<table>…</table>"), _quoted("<head>…</head>")
    no_heading = f"NOT {_has(f'<h[1-6]{b}b', 't')}"
    generic = ", ".join(_short(_first(rf"<a{b}b[^>]*>{b}s*{t}{b}s*<{b}/a>")) for t in GENERIC_ANCHORS)
    old = ", ".join(_short(_first(rf"<{t}{b}b[^>]*>")) for t in DEPRECATED)
    some = lambda items: f"list_filter([{items}], lambda s: s <> '')"
    many = lambda key, most, size=300: _shorts(f"{_all(key)}[:{most}]", size)
    image = _when("len(images) > 0", _short("images[1]"))
    robots = _first("robots", 0, "head")
    meaningful = " + ".join(f"n_{t}" for t in SEMANTIC_TAGS)
    return [
        ("llm_friendly", "L01", "error", _when("n_h1 = 0", "body")),
        ("llm_friendly", "L02", "warning", _when("n_h1 > 1", _short(_first(rf"<h1{b}b[^>]*>[{b}s{b}S]*?<{b}/h1>")))),
        ("llm_friendly", "L03", "warning", "list_transform(list_filter(list_zip(levels[:-2], levels[2:]), lambda x: x[2] > x[1] + 1)[:3], lambda x: 'h' || x[1] || ' > h' || x[2])"),
        ("llm_friendly", "L04", "error", _when("n_main = 0", "body")),
        ("llm_friendly", "L05", "warning", _when("n_nav = 0", "body")),
        ("llm_friendly", "L06", "warning", some(generic)),
        ("llm_friendly", "L07", "error", many("empty_anchor", 3)),
        ("llm_friendly", "L08", "error", image),
        ("llm_friendly", "L09", "warning", _shorts(f"list_filter({_all('onclick_div')}[:2], lambda t: NOT {_has('button_role', 't')})")),
        ("llm_friendly", "L10", "warning", _when("len(layout) > 0", _short("layout[1]", 250))),
        ("llm_friendly", "L10b", "info", _when("len(layout) > 1", cut)),
        ("llm_friendly", "L11", "info", _when(_has("deep"), _short(_first("deep"), 250))),
        ("w3c", "W01", "error", "spans"),
        ("w3c", "W02", "error", "list_transform(list_filter(list_distinct(ids), lambda i: len(list_filter(ids, lambda j: j = i)) > 1), lambda i: 'id=\"' || i || '\"')"),
        ("w3c", "W03", "error", some(old)),
        ("w3c", "W04", "error", many("two_anchors", 2, 250)),
        ("w3c", "W05", "error", many("anchor_button", 2, 250)),
        ("w3c", "W06", "error", many("block_in_p", 3, 250)),
        ("w3c", "W07", "error", image),
        ("w3c", "W08", "error", _when("n_main > 1", "'<main>'")),
        ("seo", "S01", "error", _when("title_tag = ''", gone)),
        ("seo", "S02", "error", _when("title_tag <> '' AND length(title) < 10", _short("title_tag"))),
        ("seo", "S03", "warning", _when("title_tag <> '' AND length(title) > 65", _short("title_tag"))),
        ("seo", "S04", "error", _when("description_tag = ''", gone)),
        ("seo", "S05", "warning", _when("description_tag <> '' AND length(description) < 70", _short("description_tag"))),
        ("seo", "S06", "info", _when("description_tag <> '' AND length(description) > 165", _short("description_tag"))),
        ("seo", "S07", "warning", _when(f"NOT {_has('canonical', 'head')}", gone)),
        ("seo", "S08", "error", _when(f"NOT {_has('viewport', 'head')}", gone)),
        ("seo", "S09", "error", _when("n_h1 = 0", "body")),
        ("seo", "S10", "warning", _when("n_h1 > 1", "'<h1>'")),
        ("seo", "S11", "warning", _when(f"NOT {_has('json_ld')}", gone)),
        ("seo", "S12", "warning", image),
        ("seo", "S13", "error", _when(f"contains(lower({_first('content', 1, robots)}), 'noindex')", _short(robots))),
        ("seo", "S14", "info", _when(f"NOT {_has('card', 'head')}", gone)),
        ("seo", "S15", "info", _when(f"len(list_distinct(list_transform({_all('lang', 1)}[:10], lambda x: lower(x)))) > 1 AND NOT {_has('hreflang', 'head')}", gone)),
        ("semantic", "M01", "error", "spans"),
        *(("semantic", f"M02_{t}", s, _when(f"n_{t} = 0", "body")) for t, s in LANDMARKS),
        ("semantic", "M03", "error", _when("n_main > 1", "'<main>'")),
        ("semantic", "M04", "warning", _when("len(plain_sections) > 0", _short("plain_sections[1]", 250))),
        ("semantic", "M04b", "info", _when("len(plain_sections) > 1", _quoted("<section>…</section>"))),
        ("semantic", "M05", "warning", _shorts(f"list_filter({_all('article')}[:5], lambda t: {no_heading})[:1]", 250)),
        ("semantic", "M06", "info", _shorts(f"list_filter({_all('nav')}[:3], lambda t: NOT {_has(f'<[uo]l{b}b', 't')})[:1]", 250)),
        ("semantic", "M07", "error", many("empty_container", 3)),
        ("semantic", "M08", "warning", _when(f"n_div + n_span > 50 AND {meaningful} < floor((n_div + n_span) * 0.1)", _quoted("<div>…</div>"))),
        ("accessibility", "A01", "error", _when(f"NOT {_has('lang', _first('html'))}", _short(f"coalesce(nullif({_first('html')}, ''), '<html>')"))),
        ("accessibility", "A02", "error", _when(f"NOT {_has('some_title')}", gone)),
        ("accessibility", "A03", "error", image),
        ("accessibility", "A04", "error", _shorts("lonely[:3]")),
        ("accessibility", "A05", "info", _when("len(lonely) > 3", "'<input>'")),
        ("accessibility", "A06", "warning", _shorts(f"list_filter({_all('placeholder_input')}[:20], lambda t: {_bare(PLACEHOLDER_SKIPS)})[:1]")),
        ("accessibility", "A07", "warning", f"{_all('tabindex')}[:2]"),
        ("accessibility", "A08", "warning", _shorts(f"list_filter({_all('new_tab')}[:5], lambda t: NOT {_has('noopener', 't')})[:1]")),
        ("accessibility", "A09", "error", _shorts(f"list_filter({_all('empty_button')}[:3], lambda t: NOT {_has('aria_label', 't')})")),
        ("accessibility", "A10", "error", many("hidden_focus", 2)),
        ("accessibility", "A11", "warning", _shorts("headless[:1]", 250)),
        ("accessibility", "A12", "info", _when(f"NOT {_has('skip_link')} AND n_nav > 0", _quoted("<body>…</body>"))),
    ]


_TOTALS = {
    "L02": "n_h1", "S10": "n_h1", "W08": "n_main", "M03": "n_main", "L08": "least(len(images), 5)", "W07": "least(len(images), 5)", "S12": "least(len(images), 3)", "A03": "least(len(images), 5)",
    "L10": "len(layout)", "L10b": "len(layout)", "M04": "len(plain_sections)", "M04b": "len(plain_sections)", "A05": "len(lonely)", "A11": "len(headless)",
}


def _bare(skips: tuple[str, ...]) -> str:
    name = _first("input_id", 1, "t")
    return f"NOT list_contains({_list(skips)}, lower({_first('type', 1, 't')})) AND NOT {_has('aria', 't')} AND ({name} = '' OR NOT list_contains(labels, {name}))"


def _fired_sql(pages: str) -> str:
    """CTEs up to ``fired(page_id, r)``, one struct per rule with its snippets and the number it tells."""
    counts = ", ".join(f"len(regexp_extract_all(structure, {L(open_tag(t))})) AS n_{t}" for t in ("h1", "div", "span", *SEMANTIC_TAGS))
    td, th, thead = (_has(open_tag(t), "t") for t in ("td", "th", "thead"))
    body = L(r"(?-i)<body\b[^>]*>")
    rows = ", ".join(f"{{'criterion': '{c}', 'rule_id': '{r}', 'severity': '{s}', 'snippets': {x}, 'total': CAST({_TOTALS.get(r, 'NULL')} AS INTEGER)}}" for c, r, s, x in _snippets())
    return f"""
WITH src AS (SELECT * FROM ({pages}) WHERE html IS NOT NULL),
{children_cte()},
f AS (SELECT page_id, html, {_strip('html', INERT)} AS structure, {_first('head')} AS head, {_all('label_for', 1)} AS labels FROM src),
g AS (
  SELECT *, {counts}, list_transform({_all('heading', 1)}, lambda x: CAST(x AS INTEGER)) AS levels, list_transform({_all('id', 1)}, lambda x: lower(x)) AS ids,
    coalesce(nullif(regexp_extract(html, {body}), ''), '<body>') AS body,
    list_filter({_all('img')}, lambda t: NOT {_has('alt', 't')}) AS images,
    list_filter({_all('table')}[:5], lambda t: {td} AND NOT {th} AND NOT {thead}) AS layout,
    list_filter({_all('table')}[:5], lambda t: {td} AND NOT {th}) AS headless,
    {_first('title', 0, 'head')} AS title_tag, {_first('description', 0, 'head')} AS description_tag,
    regexp_replace(regexp_replace({_first('title', 1, 'head')}, '<[^>]+>', '', 'g'), {_TRIM}, '', 'g') AS title,
    regexp_replace({_first('content', 1, _first('description', 0, 'head'))}, {_TRIM}, '', 'g') AS description,
    list_filter({_all('section')}[:10], lambda t: NOT {_has('<h[1-6]' + chr(92) + 'b', 't')}) AS plain_sections,
    list_filter({_all('input')}[:30], lambda t: {_bare(UNLABELLED_SKIPS)}) AS lonely
  FROM f
),
h AS (SELECT g.*, coalesce(v.spans, []) AS spans FROM g LEFT JOIN (SELECT page_id, list(span) AS spans FROM violations GROUP BY 1) v USING (page_id)),
fired AS (SELECT page_id, unnest([{rows}]) AS r FROM h)"""


def rules_sql(pages: str = "SELECT page_id, html FROM pages", where: str = "TRUE") -> str:
    """``page_id, criterion, rule_id, severity, n, n_matches`` of every rule that fires."""
    return f"""{_fired_sql(pages)}
SELECT page_id, r.criterion AS criterion, r.rule_id AS rule_id, r.severity AS severity, CAST(len(r.snippets) AS INTEGER) AS n, coalesce(r.total, CAST(len(r.snippets) AS INTEGER)) AS n_matches
FROM fired WHERE len(r.snippets) > 0 AND {where}"""


def issues_sql(pages: str = "SELECT page_id, html FROM pages") -> str:
    """One row per issue, with its texts and its snippet."""
    texts = ", ".join(f"({_quoted(k)}, {_quoted(says)}, {_quoted(advice)})" for k, (says, advice) in TEXTS.items())
    return f"""{_fired_sql(pages)},
texts AS (SELECT * FROM (VALUES {texts}) t(rule_id, says, advice)),
rows AS (SELECT page_id, r.criterion AS criterion, r.rule_id AS rule_id, r.severity AS severity, r.total AS total, unnest(r.snippets) AS html_snippet FROM fired)
SELECT page_id, criterion, rows.rule_id AS rule_id, severity, says || coalesce(': ' || CAST(total AS VARCHAR), '') AS issue, advice AS recommendation, html_snippet FROM rows JOIN texts ON texts.rule_id = rows.rule_id"""


def scores_sql(pages: str = "SELECT page_id, html FROM pages") -> str:
    return f"""
WITH r AS ({rules_sql(pages)}),
every AS (SELECT page_id, unnest(['llm_friendly', 'w3c', 'seo', 'semantic', 'accessibility']) AS criterion FROM ({pages}) WHERE html IS NOT NULL),
s AS (SELECT page_id, criterion, sum(CASE severity WHEN 'error' THEN 10 * n WHEN 'warning' THEN 4 * n ELSE n END) AS lost FROM r GROUP BY ALL)
SELECT page_id, criterion, CAST(greatest(0, least(92, 92 - coalesce(lost, 0))) AS INTEGER) AS score FROM every LEFT JOIN s USING (page_id, criterion)"""


def overall_sql(pages: str = "SELECT page_id, html FROM pages") -> str:
    return f"""
WITH s AS ({scores_sql(pages)}),
w AS (
  SELECT page_id, max(score) FILTER (criterion = 'llm_friendly') AS llm_friendly, max(score) FILTER (criterion = 'w3c') AS w3c,
    max(score) FILTER (criterion = 'seo') AS seo, max(score) FILTER (criterion = 'semantic') AS semantic,
    max(score) FILTER (criterion = 'accessibility') AS accessibility FROM s GROUP BY page_id
),
o AS (SELECT *, CAST(floor((llm_friendly + w3c + seo + semantic + accessibility) / 5.0 + 0.5) AS INTEGER) AS overall_score FROM w)
SELECT *, CASE WHEN overall_score >= 80 THEN 'good' WHEN overall_score >= 60 THEN 'fair' WHEN overall_score >= 40 THEN 'poor' ELSE 'bad' END AS grade FROM o"""
