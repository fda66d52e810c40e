"""Queries of the audit operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge import streaming
from sitegauge.functions import text
from sitegauge.functions.patterns import java
from sitegauge.functions.patterns import linear as L
from sitegauge.operators import evaluations, fragments, locate, metrics, neighbours, resources, rules, views
from sitegauge.plans import rule_sql
from sitegauge.settings import Settings
from sitegauge.sources import spread, table

#: The domain whose style sheets count as the site's own.
DOMAIN = "example"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a query under its function's name, with its SQL where there is one."""

    def register(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages").select("page_id", "url", "host", "html"))


def varied_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages, each with the markup of one defect added, so that every rule has cases."""
    defects = F.array(*[F.lit(x) for x in rule_sql.DEFECTS])
    kind = F.pmod(F.col("page_id"), F.lit(len(rule_sql.DEFECTS))).cast("int")
    return pages(spark, d).withColumn("html", F.concat("html", F.element_at(defects, kind + 1)))


def _rule_query(criterion: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rules.findings(pages(spark, d), criterion).select("page_id", "criterion", "rule_id", "severity", "n", "n_matches")

    run.__name__ = f"rules_{criterion}"
    query(rule_sql.rules_sql(where=f"r.criterion = '{criterion}'"))(run)


for _criterion in rules.CRITERIA:
    _rule_query(_criterion)


@query(rule_sql.rules_sql(rule_sql.varied_sql()))
def rules_on_varied_pages(spark: SparkSession, d: str) -> DataFrame:
    return rules.findings(varied_pages(spark, d)).select("page_id", "criterion", "rule_id", "severity", "n", "n_matches")


@query(rule_sql.scores_sql())
def criterion_scores(spark: SparkSession, d: str) -> DataFrame:
    return rules.criterion_scores(pages(spark, d))


@query(rule_sql.overall_sql())
def overall_scores(spark: SparkSession, d: str) -> DataFrame:
    return rules.overall_scores(pages(spark, d))


# --- size, text and markup -------------------------------------------------------------

_STRIPPED = rule_sql._strip("html", text.UNSEEN)
_MARKUP = rule_sql._strip(_STRIPPED, text.STYLING)


def _collapsed(sql: str) -> str:
    return f"regexp_replace(regexp_replace({sql}, {L(chr(92) + 's+')}, ' ', 'g'), {L('^' + chr(92) + 's+|' + chr(92) + 's+$')}, '', 'g')"


def _decoded(sql: str) -> str:
    for name, plain in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        sql = f"regexp_replace({sql}, '(?i)&{name};', '{plain}', 'g')"
    # numeric references of one character become one character of any kind; length is all that counts
    return f"regexp_replace(replace({sql}, '&#39;', chr(39)), '&#(?:[xX][0-9a-fA-F]{{1,6}}|[0-9]{{1,7}});', 'x', 'g')"


_VISIBLE = f"length({_collapsed(_decoded(f'''regexp_replace({_STRIPPED}, '<[^>]+>', ' ', 'g')'''))})"
_METRICS = f"""
SELECT page_id, CAST(strlen(html) AS INTEGER) AS html_bytes, CAST(strlen({_MARKUP}) AS INTEGER) AS markup_bytes, CAST({_VISIBLE} AS INTEGER) AS visible_chars
FROM pages WHERE html IS NOT NULL"""
_TEXT_METRICS = f"SELECT *, floor(markup_bytes / greatest(visible_chars, 1) * 100 + 0.5) / 100 AS html_to_text_ratio FROM ({_METRICS})"
_CSS_METRICS = f"""
SELECT page_id, css_chars, css_ext_count, css_inline_count, floor(css_chars / greatest(visible_chars, 1) * 100 + 0.5) / 100 AS css_to_text_ratio FROM (
  SELECT page_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(html, {L(metrics.STYLE_BLOCK)}, 1), lambda s: length(s))), 0) AS INTEGER) AS css_chars,
    CAST(len(regexp_extract_all(html, {L(metrics.sheet_pattern(DOMAIN))})) AS INTEGER) AS css_ext_count,
    CAST(len(regexp_extract_all(html, {L(metrics.STYLE_BLOCK)})) AS INTEGER) AS css_inline_count, {_VISIBLE} AS visible_chars
  FROM pages WHERE html IS NOT NULL)"""


@query(_TEXT_METRICS)
def text_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.text_metrics(pages(spark, d))


@query(_CSS_METRICS)
def css_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.css_metrics(pages(spark, d), DOMAIN)


@query(f"""
WITH m AS (SELECT * FROM ({_TEXT_METRICS}) JOIN ({_CSS_METRICS}) USING (page_id)),
c AS (SELECT page_id, list_filter([
  CASE WHEN html_to_text_ratio > 30 THEN 'ratio_very_high' WHEN html_to_text_ratio > 15 THEN 'ratio_high' ELSE 'ratio_fine' END,
  CASE WHEN css_to_text_ratio > 2 THEN 'inline_css_heavy' WHEN css_inline_count > 2 THEN 'many_style_blocks' END,
  CASE WHEN css_ext_count > 5 THEN 'many_style_sheets' END, CASE WHEN html_bytes > 200000 THEN 'page_too_large' END,
  CASE WHEN markup_bytes > 80000 THEN 'markup_too_large' END, 'minify'], lambda x: x IS NOT NULL)[:6] AS t FROM m)
SELECT page_id, CAST(unnest(range(len(t))) AS INTEGER) AS ord, unnest(t) AS tactic FROM c""")
def doc_size_advice(spark: SparkSession, d: str) -> DataFrame:
    return metrics.size_advice(pages(spark, d), DOMAIN)


@query(f"""
SELECT page_id, CAST(length(s) AS INTEGER) AS n_chars, md5(s) AS digest FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKUP}, '[\\t\\f\\x0B]+', ' ', 'g'), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {L('^' + chr(92) + 's+|' + chr(92) + 's+$')}, '', 'g') AS s
  FROM pages WHERE html IS NOT NULL)""")
def stripped_html(spark: SparkSession, d: str) -> DataFrame:
    s = pages(spark, d).filter("html is not null").select("page_id", metrics.stripped_html(F.col("html")).alias("s"))
    return s.select("page_id", F.length("s").alias("n_chars"), F.md5("s").alias("digest"))


@query()
def bloated_segments(spark: SparkSession, d: str) -> DataFrame:
    found = fragments.bloated_segments(pages(spark, d)).drop("snippet")
    return found.withColumn("band", views.segment_band(F.col("ratio")))


@query()
def html_chunks(spark: SparkSession, d: str) -> DataFrame:
    return fragments.html_chunks(pages(spark, d)).select("page_id", "chunk", "bytes", F.md5("text").alias("digest"))


_STRIPPED_HTML = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKUP}, '[\\t\\f\\x0B]+', ' ', 'g'), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {L('^' + chr(92) + 's+|' + chr(92) + 's+$')}, '', 'g')"""


@query(f"SELECT page_id, md5(regexp_replace(s, {L(chr(92) + 's+')}, '', 'g')) AS digest, true AS within FROM (SELECT page_id, {_STRIPPED_HTML} AS s FROM pages WHERE html IS NOT NULL)")
def chunks_reassembled(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a page put together again without their marks and white space, and whether
    every one keeps to the budget and the room for a mark."""
    parts = fragments.html_chunks(pages(spark, d))
    whole = parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("c"), F.max("bytes").alias("most"))
    joined = F.regexp_replace(F.array_join(F.transform("c", lambda c: c["text"]), ""), java(r"\s+"), "")
    joined = F.regexp_replace(joined, "<!--chunk:[a-z-]+-->", "")
    return whole.select("page_id", F.md5(joined).alias("digest"), (F.col("most") <= fragments.CHUNK_BYTES + 64).alias("within"))


@query("SELECT CAST(0 AS BIGINT) AS n_overlapping, CAST(0 AS BIGINT) AS n_misplaced")
def segments_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """How many segments of a page overlap another one of its five, or do not stand where they say."""
    placed = fragments.bloated_segments(pages(spark, d)).join(pages(spark, d).select("page_id", "html"), "page_id")
    begins = F.startswith(F.substr("html", F.col("begin") + 1, F.length("snippet")), F.col("snippet"))
    of_page = placed.groupBy("page_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"), F.count_if(~begins).alias("bad"))
    clash = F.exists("spans", lambda a: F.size(F.filter("spans", lambda b: (a["begin"] < b["end"]) & (b["begin"] < a["end"]))) > 1)
    return of_page.agg(F.count_if(clash).alias("n_overlapping"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_misplaced"))


_FACTS = f"""SELECT page_id, {rule_sql._strip("coalesce(html, '')", text.INERT)} AS s, coalesce(html, '') AS html FROM pages"""
_COUNTED = ("h1", "main", "nav", "header", "footer", "div", "span")


@query(f"SELECT page_id, {', '.join(f'CAST(len(regexp_extract_all(s, {L(rules.open_tag(t))})) AS INTEGER) AS n_{t}' for t in _COUNTED)} FROM ({_FACTS} WHERE html IS NOT NULL)")
def structural_facts(spark: SparkSession, d: str) -> DataFrame:
    return rules.with_facts(pages(spark, d).select("page_id", "html")).select("page_id", *[F.col(f"n_{t}") for t in _COUNTED])


@query(f"WITH src AS ({rule_sql.varied_sql()}), {rule_sql.children_cte()} SELECT page_id, parent, child, count(*) AS n FROM violations GROUP BY ALL")
def direct_child_violations(spark: SparkSession, d: str) -> DataFrame:
    found = text.each(varied_pages(spark, d), rules.child_violations(F.col("html")), "v", "page_id")
    return found.groupBy("page_id", F.col("v.parent").alias("parent"), F.col("v.child").alias("child")).agg(F.count("*").alias("n"))


@query(f"""
WITH i AS (SELECT page_id, lower(unnest(regexp_extract_all(html, {L(rules.P['id'])}, 1))) AS id FROM ({rule_sql.varied_sql()}))
SELECT page_id, id, count(*) AS n FROM i GROUP BY ALL HAVING count(*) > 1""")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = text.each(varied_pages(spark, d), text.find_all(F.col("html"), rules.P["id"], 1), "id", "page_id")
    return ids.groupBy("page_id", F.lower("id").alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


@query(f"""
WITH s AS ({rule_sql.scores_sql()}), j AS (SELECT * FROM s JOIN (SELECT page_id, host FROM pages) USING (page_id))
SELECT host, criterion, count(*) AS n_pages, floor(avg(score) * 100 + 0.5) / 100 AS mean_score FROM j GROUP BY ROLLUP (host, criterion)""")
def site_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return views.site_rollup(rules.criterion_scores(p), p)


@query(rule_sql.issues_sql())
def issue_rows(spark: SparkSession, d: str) -> DataFrame:
    return rules.issues(pages(spark, d)).drop("ord")


@query(rule_sql.issues_sql(rule_sql.varied_sql()))
def issue_rows_of_varied_pages(spark: SparkSession, d: str) -> DataFrame:
    return rules.issues(varied_pages(spark, d)).drop("ord")


@query(f"""
WITH o AS ({rule_sql.overall_sql()}), i AS ({rule_sql.issues_sql()}), s AS ({rule_sql.scores_sql()}),
c AS (SELECT page_id, criterion, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT page_id, criterion, concat_ws('|', rule_id, severity, issue, recommendation, html_snippet) AS line FROM i) GROUP BY ALL)
SELECT s.page_id, o.overall_score, o.grade, s.criterion, s.score, CAST(coalesce(c.n, 0) AS INTEGER) AS n_issues, c.digest FROM s JOIN o USING (page_id) LEFT JOIN c ON c.page_id = s.page_id AND c.criterion = s.criterion""")
def page_reports(spark: SparkSession, d: str) -> DataFrame:
    """The nested report of every page, its issues as their number and a digest."""
    area = text.each(rules.reports(pages(spark, d)), F.col("criteria"), "c", "page_id", "overall_score", "grade")
    lines = F.array_sort(F.transform("c.issues", lambda i: F.concat_ws("|", i["rule_id"], i["severity"], i["issue"], i["recommendation"], i["html_snippet"])))
    digest = F.when(F.size("c.issues") > 0, F.md5(F.array_join(lines, "\n")))
    return area.select("page_id", "overall_score", "grade", "c.criterion", "c.score", F.size("c.issues").alias("n_issues"), digest.alias("digest"))


@query(f"""
WITH l AS (SELECT page_id, list_transform({rule_sql._all('heading', 1)}, lambda x: CAST(x AS INTEGER)) AS v FROM ({rule_sql.varied_sql()}) WHERE html IS NOT NULL),
p AS (SELECT page_id, unnest(list_zip(v[:-2], v[2:], range(len(v) - 1))) AS z FROM l)
SELECT page_id, CAST(z[3] AS INTEGER) AS ord, z[1] AS from_rank, z[2] AS to_rank FROM p WHERE z[2] > z[1] + 1""")
def heading_skips(spark: SparkSession, d: str) -> DataFrame:
    """All skipped heading ranks, with the number of the heading before."""
    levels = rules.with_facts(varied_pages(spark, d).select("page_id", "html")).select("page_id", "levels")
    pairs = levels.select("page_id", F.posexplode(F.arrays_zip(F.slice("levels", 1, F.greatest(F.size("levels") - 1, F.lit(0))).alias("a"), F.slice("levels", 2, F.size("levels")).alias("b"))).alias("ord", "z"))
    return pairs.filter("z.b > z.a + 1").select("page_id", "ord", F.col("z.a").alias("from_rank"), F.col("z.b").alias("to_rank"))


@query(f"""
WITH f AS (SELECT page_id, html, {rule_sql._all('label_for', 1)} AS labels FROM ({rule_sql.varied_sql()}) WHERE html IS NOT NULL)
SELECT page_id, unnest(list_filter({rule_sql._all('input')}[:30], lambda t: {rule_sql._bare(rules.UNLABELLED_SKIPS)})) AS input FROM f""")
def unlabelled_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.with_facts(varied_pages(spark, d).select("page_id", "html"))
    return text.each(rows, F.col("lonely"), "input", "page_id")


# --- findings of an external evaluator ---------------------------------------------------


def model_issues(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "model_issues")).withColumn("severity", F.lower(F.trim("severity")))


_ISSUES = "SELECT * REPLACE (lower(trim(severity)) AS severity) FROM model_issues"


@query(f"SELECT issue_id FROM ({_ISSUES}) WHERE severity IN ('error', 'warning', 'info') AND score BETWEEN 0 AND 100 AND issue <> '' AND recommendation <> '' AND html_snippet <> ''")
def valid_findings(spark: SparkSession, d: str) -> DataFrame:
    return evaluations.valid_findings(model_issues(spark, d)).select("issue_id")


def _dropped(where: str = "TRUE") -> str:
    e = evaluations
    m = lambda col, p: f"regexp_matches({col}, {L(p)})"
    fine = []
    for parent, allowed in rules.ALLOWED_CHILDREN.items():
        fine.append(f"({m('snippet', rules.parent_span(parent))} AND {m('subject', chr(92) + 'b' + parent + chr(92) + 'b')} AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.issue_id = j.issue_id AND bad.parent = '{parent}'))")
    spans = " UNION ALL ".join(f"SELECT issue_id, '{t}' AS parent, {rule_sql._list(a)} AS allowed, regexp_extract(snippet, {L(rules.parent_span(t))}, 1) AS inner_html FROM subjects WHERE {m('snippet', rules.parent_span(t))}" for t, a in rules.ALLOWED_CHILDREN.items())
    checks = [(name, m("subject", p)) for name, p in e.SCOPE.items()] + [
        ("vague", m("issue", e.VAGUE)),
        ("children_fine", f"({' OR '.join(fine)})"),
        ("list_order", f"({m('subject', e.LIST_ORDER)} OR ((contains(lower(subject), 'dt') OR contains(lower(subject), 'dd')) AND lower(regexp_extract(snippet, {L('<(dt|dd)' + chr(92) + 'b')}, 1)) = 'dt'))"),
        ("root_nesting", f"({m('subject', e.NESTING)} AND {m('snippet', e.ROOT)})"),
        ("h1_present", f"({m('issue', e.ABOUT_H1)} AND (h1 >= 1 OR has_root) AND {m('issue', e.MISSING)})"),
        ("h1_single", f"({m('issue', e.ABOUT_H1)} AND h1 <= 1 AND {m('issue', e.DOUBLED)})"),
        ("main_present", f"({m('issue', e.ABOUT_MAIN)} AND main >= 1 AND {m('issue', e.MISSING)})"),
        ("main_single", f"({m('issue', e.ABOUT_MAIN)} AND main <= 1 AND {m('issue', e.DOUBLED)})"),
    ]
    cases = " ".join(f"WHEN {c} THEN '{name}'" for name, c in checks)
    root = "<div" + chr(92) + "b[^>]*" + e.ROOT
    return f"""
WITH subjects AS (SELECT *, issue || ' ' || coalesce(recommendation, '') AS subject, coalesce(html_snippet, '') AS snippet FROM ({_ISSUES})),
facts AS (SELECT page_id, len(regexp_extract_all(s, {L(rules.open_tag('h1'))})) AS h1, len(regexp_extract_all(s, {L(rules.open_tag('main'))})) AS main, {m('html', root)} AS has_root FROM ({_FACTS})),
spans AS ({spans}),
tags AS (SELECT *, unnest({rule_sql._all('tag', 0, 'inner_html')}) AS tag, generate_subscripts({rule_sql._all('tag', 0, 'inner_html')}, 1) AS pos FROM spans),
steps AS (SELECT *, starts_with(tag, '</') AS closing, lower({rule_sql._first('tag_name', 1, 'tag')}) AS name, CASE WHEN starts_with(tag, '</') THEN -1 WHEN ends_with(tag, '/>') THEN 0 ELSE 1 END AS step FROM tags),
sums AS (SELECT *, sum(step) OVER (PARTITION BY issue_id, parent ORDER BY pos) AS total FROM steps),
floors AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY issue_id, parent ORDER BY pos)) AS depth FROM sums),
walked AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY issue_id, parent ORDER BY pos) AS before FROM floors),
bad AS (SELECT DISTINCT issue_id, parent FROM walked WHERE NOT closing AND before = 0 AND NOT list_contains(allowed, name)),
j AS (SELECT subjects.*, coalesce(f.h1, 0) AS h1, coalesce(f.main, 0) AS main, coalesce(f.has_root, FALSE) AS has_root FROM subjects LEFT JOIN facts f USING (page_id)),
dropped AS (SELECT j.*, CASE {cases} END AS drop_reason FROM j)
SELECT * FROM dropped WHERE {where}"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    return evaluations.drop_reason(model_issues(spark, d), evaluations.page_facts(p), p)


@query(f"SELECT issue_id, drop_reason FROM ({_dropped('drop_reason IS NOT NULL')})")
def ground_truth_filter(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).filter("drop_reason is not null").select("issue_id", "drop_reason")


@query()
def satisfied_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return evaluations.satisfied_suggestions(model_issues(spark, d), pages(spark, d))


#: Pages with a finding that proposes a wrapper, and whether all its places have it.
_PLANTED = (
    ('<main><p class="a b">x</p></main>', '<p class="b">', "wrap it in <main>", True),
    ('<p class="a b">x</p><main></main>', '<p class="b">', "wrap it in <main>", False),
    ('<article><div id="q">1</div></article><div id="q">2</div>', '<div id="q">1</div>', "use an article", True),
    ('<section><b data-k="v">1</b></section><b data-k="v">2</b>', '<i data-k="V">', "wrap in a section", False),
    ("<nav><br><ul><li>1</li></ul></nav>", "<li>1</li>", "replace the list with nav", True),
    ("<p>1</p>", "<td>9</td>", "wrap in a section", False),
)


@query(f"SELECT page_id FROM pages WHERE page_id % {len(_PLANTED)} IN ({', '.join(str(k) for k, case in enumerate(_PLANTED) if case[3])})")
def satisfied_suggestions_planted(spark: SparkSession, d: str) -> DataFrame:
    """One planted page and finding for every page of the table."""
    kind = F.pmod(F.col("page_id"), F.lit(len(_PLANTED))).cast("int") + 1
    one = lambda k: F.element_at(F.array(*[F.lit(case[k]) for case in _PLANTED]), kind)
    planted = table(spark, d, "pages").select("page_id", one(0).alias("html"), one(1).alias("html_snippet"), one(2).alias("issue"), F.lit(None).cast("string").alias("recommendation"), F.col("page_id").alias("issue_id"))
    return evaluations.satisfied_suggestions(planted.drop("html"), planted.select("page_id", "html")).select(F.col("issue_id").alias("page_id"))


_CAPS = " ".join(f"WHEN '{c}' THEN {n}" for c, n in evaluations.CAPS.items())


@query(f"""
WITH k AS (SELECT *, CASE WHEN criterion IN ('semantic', 'w3c')
    THEN severity || '|' || issue || '|' || coalesce(substring(regexp_replace(html_snippet, {L(chr(92) + 's+')}, ' ', 'g'), 1, 120), '')
    ELSE severity || '|' || substring(regexp_replace(lower(issue), {L('^' + chr(92) + 's+|' + chr(92) + 's+$')}, '', 'g'), 1, 100) END AS key FROM ({_dropped('drop_reason IS NULL')})),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, criterion, key ORDER BY chunk, ord, issue_id) AS nth FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, criterion ORDER BY chunk, ord, issue_id) AS rank FROM f WHERE nth = 1)
SELECT page_id, criterion, chunk, ord, issue_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= CASE criterion {_CAPS} ELSE 40 END""")
def merged_findings(spark: SparkSession, d: str) -> DataFrame:
    return evaluations.merged_findings(judged(spark, d).filter("drop_reason is null"))


@query(f"""
WITH v AS (SELECT *, CASE WHEN score BETWEEN 0 AND 100 THEN score END AS good FROM ({_dropped()})),
c AS (SELECT page_id, criterion, chunk, arg_min(good, (ord, issue_id)) FILTER (good IS NOT NULL) AS score, count(*) FILTER (drop_reason IS NULL) AS kept, count(*) FILTER (drop_reason IS NOT NULL) AS dropped FROM v GROUP BY ALL),
m AS (SELECT page_id, criterion, CAST(sum(kept) AS BIGINT) AS n_kept, CAST(sum(dropped) AS BIGINT) AS n_dropped, CAST(floor(avg(score) + 0.5) AS INTEGER) AS mean FROM c GROUP BY ALL)
SELECT page_id, criterion, n_kept, n_dropped, CAST(CASE WHEN n_dropped > 0 AND n_kept = 0 THEN least(100, mean + 4 * n_dropped) ELSE mean END AS INTEGER) AS score FROM m""")
def merged_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluations.merged_scores(judged(spark, d))


_MERGED_SCORES = SQL["merged_scores"]
_NONE = ", ".join(f"'{t}'" for t in evaluations.NO_EVALUATION)


@query(f"""
WITH src AS (SELECT page_id, html FROM pages WHERE html IS NOT NULL), {rule_sql.children_cte()},
seen AS (SELECT DISTINCT page_id FROM model_issues),
kept AS (SELECT m.page_id, m.criterion, m.rank, i.severity, i.issue, i.recommendation, i.html_snippet FROM ({SQL["merged_findings"]}) m JOIN ({_ISSUES}) i USING (issue_id) WHERE m.page_id IN (SELECT page_id FROM src)),
v AS (SELECT page_id, 'element not allowed as direct child: ' || child || ' in ' || parent AS issue, span FROM violations WHERE page_id IN (SELECT page_id FROM seen)),
own AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.page_id = v.page_id AND k.criterion = 'semantic' AND k.severity = 'error' AND k.issue = v.issue AND coalesce(substring(regexp_replace(k.html_snippet, {L(chr(92) + 's+')}, ' ', 'g'), 1, 120), '') = substring(v.span, 1, 120))),
n AS (SELECT page_id, count(*) AS n FROM own GROUP BY 1)
SELECT kept.page_id, criterion, CAST(rank + CASE WHEN criterion = 'semantic' THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS rank, 'model' AS origin, severity, issue, recommendation, html_snippet FROM kept LEFT JOIN n ON n.page_id = kept.page_id
UNION ALL SELECT page_id, 'semantic', NULL, 'rules', 'error', issue, '{evaluations.CHILD_ADVICE}', span FROM own
UNION ALL SELECT page_id, unnest({rule_sql._list(tuple(evaluations.CAPS))}), 1, 'none', 'error', {_NONE} FROM src WHERE page_id NOT IN (SELECT page_id FROM seen)""")
def merged_report(spark: SparkSession, d: str) -> DataFrame:
    """The ranks of the rules' own findings, which SQL has no order for, are left out."""
    rows = evaluations.merged_report(judged(spark, d), pages(spark, d))
    return rows.withColumn("rank", F.when(F.col("origin") != "rules", F.col("rank")))


@query("""
WITH c AS (SELECT page_id, arg_min(recommendation, chunk) AS recommendation FROM (SELECT page_id, chunk, min(recommendation) AS recommendation FROM model_issues WHERE regexp_matches(recommendation, '[^\\s]') GROUP BY 1, 2) GROUP BY 1)
SELECT page_id, CAST(strlen(html) AS INTEGER) AS size, recommendation FROM pages LEFT JOIN c USING (page_id) WHERE html IS NOT NULL""")
def document_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The advice of each chunk is taken from its findings, as the tables have none on size."""
    chunks = model_issues(spark, d).filter(F.length(F.trim("recommendation")) > 0).groupBy("page_id", "chunk").agg(F.min("recommendation").alias("recommendation"))
    return evaluations.doc_size(chunks, pages(spark, d))


@query(f"""
WITH src AS (SELECT page_id, html FROM pages WHERE html IS NOT NULL), {rule_sql.children_cte()}, v AS (SELECT page_id, count(*) AS n FROM violations GROUP BY 1),
m AS ({_MERGED_SCORES}), e AS (SELECT page_id, unnest({rule_sql._list(tuple(evaluations.CAPS))}) AS criterion FROM src)
SELECT e.page_id, e.criterion, CAST(greatest(0, coalesce(m.score, 0) - CASE WHEN e.criterion = 'semantic' THEN 2 * coalesce(v.n, 0) ELSE 0 END) AS INTEGER) AS score
FROM e LEFT JOIN m ON m.page_id = e.page_id AND m.criterion = e.criterion LEFT JOIN v ON v.page_id = e.page_id""")
def final_scores(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    violations = text.each(p, rules.child_violations(F.col("html")), "v", "page_id")
    return evaluations.final_scores(evaluations.merged_scores(judged(spark, d)), p, violations)


@query(f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY list_position(['llm_friendly', 'w3c', 'seo', 'semantic', 'accessibility'], criterion), chunk, ord, issue_id) AS rank
  FROM ({_ISSUES}) WHERE length(regexp_replace(html_snippet, {L('^' + chr(92) + 's+|' + chr(92) + 's+$')}, '', 'g')) >= 6)
SELECT page_id, issue_id, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20""")
def fix_queue(spark: SparkSession, d: str) -> DataFrame:
    return evaluations.fix_queue(model_issues(spark, d))


_T = L("^" + chr(92) + "s+|" + chr(92) + "s+$")


@query(f"""
SELECT page_id, severity, regexp_replace(issue, {_T}, '', 'g') AS issue, regexp_replace(coalesce(recommendation, ''), {_T}, '', 'g') AS recommendation, count(*) AS n_issues,
  count(DISTINCT nullif(regexp_replace(coalesce(html_snippet, ''), {_T}, '', 'g'), '')) AS n_snippets FROM ({_ISSUES}) GROUP BY 1, 2, 3, 4""")
def grouped_issues(spark: SparkSession, d: str) -> DataFrame:
    return views.grouped_issues(model_issues(spark, d))


@query(f"""
WITH k AS (SELECT page_id, severity, regexp_replace(issue, {_T}, '', 'g') AS issue, regexp_replace(coalesce(recommendation, ''), {_T}, '', 'g') AS recommendation,
  nullif(regexp_replace(coalesce(html_snippet, ''), {_T}, '', 'g'), '') AS snippet, chunk, ord, issue_id FROM ({_ISSUES})),
o AS (SELECT page_id, severity, issue, recommendation, snippet, min(struct_pack(a := chunk, b := ord, c := issue_id)) AS seen FROM k GROUP BY 1, 2, 3, 4, 5)
SELECT page_id, severity, issue, recommendation, struct_extract(min(seen), 'c') AS first_id, md5(coalesce(string_agg(snippet, '|' ORDER BY seen) FILTER (snippet IS NOT NULL), '')) AS digest FROM o GROUP BY 1, 2, 3, 4""")
def grouped_snippets(spark: SparkSession, d: str) -> DataFrame:
    """The snippets of every grouped finding in the order first seen, as a digest."""
    rows = views.grouped_snippets(model_issues(spark, d), ["chunk", "ord", "issue_id"])
    return rows.select("page_id", "severity", "issue", "recommendation", F.col("first_seen.issue_id").alias("first_id"), F.md5(F.array_join("snippets", "|")).alias("digest"))


# --- resources ------------------------------------------------------------------------------


def page_resources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_resources")


_FILES = "SELECT page_id, lower(kind) AS kind, url, max(content) AS content FROM page_resources WHERE content IS NOT NULL AND lower(kind) IN ('js', 'css') GROUP BY 1, 2, 3"


@query(f"""
WITH f AS (SELECT *, lower(split_part(split_part(url, '/', -1), '?', 1)) AS file, substring(content, 1, 6000) AS js_head, substring(content, 1, 2000) AS css_head FROM ({_FILES})),
p AS (SELECT *, CASE kind WHEN 'js' THEN regexp_matches(file, {L(resources.JS_PACKAGE_FILE)}) OR len(regexp_extract_all(js_head, '/\\*!')) >= 3 OR regexp_matches(js_head, {L(resources.JS_BANNER)})
    OR len(regexp_extract_all(content, '// EXTERNAL MODULE:')) >= 5 OR regexp_matches(js_head, {L(resources.JS_COPYRIGHT)})
  ELSE regexp_matches(file, {L(resources.CSS_PACKAGE_FILE)}) OR regexp_matches(css_head, {L(resources.CSS_BANNER)}) OR len(regexp_extract_all(css_head, '/\\*!')) >= 2 END AS package FROM f)
SELECT page_id, kind, count(*) AS n_files, count(*) FILTER (package) AS n_packages, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(CASE WHEN package THEN 0 ELSE length(content) END) AS BIGINT) AS app_chars FROM p GROUP BY 1, 2""")
def resource_totals(spark: SparkSession, d: str) -> DataFrame:
    # the SQL leaves package code within own scripts out of account; no script of the tables holds any
    return resources.resource_totals(page_resources(spark, d))


@query(f"""
WITH c AS (SELECT page_id, url, unnest(list_filter(list_distinct(regexp_extract_all(content, {L(resources.CLASS_NAME)}, 1)), lambda c: length(c) >= 4)) AS class FROM ({_FILES}) WHERE kind = 'css')
SELECT * FROM c""")
def css_classes(spark: SparkSession, d: str) -> DataFrame:
    css = resources.distinct_resources(page_resources(spark, d)).filter("kind = 'css'")
    return text.each(css, resources.css_classes(F.col("content")), "class", "page_id", "url")


def coverage(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The resources with ranges made up from their lengths: overlapping, nested and unexecuted ones."""
    n = F.length("content")
    part = lambda a, b, c: F.struct((n * a / 12).cast("int").alias("start"), (n * b / 12).cast("int").alias("end"), F.lit(c).alias("count"))
    made = F.array(part(3, 6, 1), part(0, 2, 2), part(4, 5, 1), part(5, 7, 3), part(9, 11, 0))
    files = resources.distinct_resources(page_resources(spark, d)).filter(F.col("kind") == kind)
    return files.select("page_id", "url", F.col("content").alias("text"), made.alias("ranges"))


@query(f"""
WITH f AS (SELECT page_id, url, length(content) AS total FROM ({_FILES}) WHERE kind = 'js' AND length(content) > 0),
u AS (SELECT *, (trunc(total * 2 / 12) - 0) + (trunc(total * 7 / 12) - trunc(total * 3 / 12)) AS used FROM f)
SELECT page_id, url, CAST(total AS INTEGER) AS total_chars, CAST(total - used AS INTEGER) AS unused_chars, CAST(floor((total - used) / total * 100 + 0.5) AS INTEGER) AS unused_pct FROM u""")
def unused_scripts(spark: SparkSession, d: str) -> DataFrame:
    return resources.unused_scripts(coverage(spark, d, "js"))


@query()
def unused_styles(spark: SparkSession, d: str) -> DataFrame:
    js = resources.distinct_resources(page_resources(spark, d)).filter("kind = 'js'")
    return resources.unused_styles(coverage(spark, d, "css"), js.select("page_id", "content"))


#: References to two files, put at the end of every fifth page.
_LINKS = """<script src="https://cdn.example/lib.js"></script><link href='https://cdn.example/a.css' rel="stylesheet"><link rel='stylesheet' href="/own.css"><script src="/own.js"></script>"""
_LINKED_PAGES = "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN html || '" + _LINKS.replace("'", "''") + "' ELSE html END AS html FROM pages"


def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).withColumn("html", F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit(_LINKS))).otherwise(F.col("html")))


_LINKED = rf"{chr(92)}bhref{chr(92)}s*=" + rf"{chr(92)}s*[{chr(92)}x22']([^{chr(92)}x22']*{DOMAIN}[^{chr(92)}x22']*)[{chr(92)}x22']"
_SCRIPTED = rf"<script{chr(92)}b[^>]*{chr(92)}bsrc{chr(92)}s*={chr(92)}s*[{chr(92)}x22']([^{chr(92)}x22']*{DOMAIN}[^{chr(92)}x22']*)[{chr(92)}x22']"
_SHEET = rf"{chr(92)}brel{chr(92)}s*={chr(92)}s*[{chr(92)}x22']stylesheet[{chr(92)}x22']"
_REFERENCED = f"""
SELECT DISTINCT page_id, 'js' AS kind, unnest(regexp_extract_all(html, {L(_SCRIPTED)}, 1)) AS url FROM ({_LINKED_PAGES})
UNION SELECT DISTINCT page_id, 'css', url FROM (
  SELECT page_id, regexp_extract(tag, {L('.*' + _LINKED)}, 1) AS url FROM (SELECT page_id, unnest(regexp_extract_all(html, {L('<link' + chr(92) + 'b[^>]*>')})) AS tag FROM ({_LINKED_PAGES}))
  WHERE regexp_matches(tag, {L(_SHEET)}) AND regexp_matches(tag, {L(_LINKED)}))"""


@query(_REFERENCED)
def referenced_files(spark: SparkSession, d: str) -> DataFrame:
    return resources.referenced_files(linked_pages(spark, d), DOMAIN)


def _over_linked(sql: str) -> str:
    return sql.replace("FROM pages", "FROM linked").replace("WHERE html IS NOT NULL", "")


@query(f"""
WITH linked AS (SELECT page_id, coalesce(html, '') AS html FROM ({_LINKED_PAGES})), m AS ({_over_linked(_TEXT_METRICS)}), c AS ({_over_linked(_CSS_METRICS)}),
f AS (SELECT page_id, html, {rule_sql._strip('html', text.INERT)} AS s FROM linked),
u AS (SELECT *, regexp_extract_all(html, {L(_SCRIPTED)}, 1) AS js, list_transform(list_filter(regexp_extract_all(html, {L('<link' + chr(92) + 'b[^>]*>')}), lambda t: regexp_matches(t, {L(_SHEET)}) AND regexp_matches(t, {L(_LINKED)})), lambda t: regexp_extract(t, {L('.*' + _LINKED)}, 1)) AS css FROM f)
SELECT page_id, html_bytes, CAST(len(regexp_extract_all(s, {L(rules.open_tag('h1'))})) AS INTEGER) AS h1_count, CAST(len(regexp_extract_all(s, {L(rules.open_tag('main'))})) AS INTEGER) AS main_count,
  regexp_matches(html, {L('<div' + chr(92) + 'b[^>]*' + evaluations.ROOT)}) AS has_root, html_to_text_ratio, css_chars AS inline_css_chars, css_ext_count, css_inline_count, css_to_text_ratio,
  array_to_string(list_sort(list_distinct(list_transform(js, lambda x: split_part(split_part(x, '?', 1), '/', -1)))), ',') AS js_files,
  array_to_string(list_sort(list_distinct(list_transform(css, lambda x: split_part(split_part(x, '?', 1), '/', -1)))), ',') AS css_files
FROM u JOIN m USING (page_id) JOIN c USING (page_id)""")
def evaluator_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = evaluations.evaluator_facts(linked_pages(spark, d), DOMAIN)
    return facts.withColumns({n: F.array_join(n, ",") for n in ("js_files", "css_files")})


@query(f"""
WITH f AS ({_FILES} UNION ALL SELECT -1, 'js', 'https://cdn.example/lib.js', 'x = 1' UNION ALL SELECT -1, 'css', 'https://cdn.example/a.css', 'a {{}}'), e AS (SELECT kind, url, max(content) AS content FROM f GROUP BY 1, 2),
r AS ({_REFERENCED})
SELECT page_id, kind, url, length(content) AS n_chars, 'captured' AS origin FROM f
UNION ALL SELECT r.page_id, kind, url, length(content), 'named' FROM r JOIN e USING (kind, url) WHERE r.page_id NOT IN (SELECT page_id FROM f WHERE page_id IS NOT NULL)""")
def resources_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Captured resources, and what pages without any name; ``origin`` tells which. The two files
    that the added references name were captured on a page of their own."""
    added = spark.createDataFrame([(-1, "https://cdn.example/lib.js", "JS", "x = 1"), (-1, "https://cdn.example/a.css", "css", "a {}")], "page_id bigint, url string, kind string, content string")
    captured = resources.distinct_resources(page_resources(spark, d).select(*added.columns).unionByName(added))
    full = resources.with_fallback(captured, resources.referenced_files(linked_pages(spark, d), DOMAIN))
    have = captured.select("page_id").distinct().withColumn("origin", F.lit("captured"))
    return full.join(have, "page_id", "left").select("page_id", "kind", "url", F.length("content").alias("n_chars"), F.coalesce("origin", F.lit("named")).alias("origin"))


@query(f"""
WITH u AS ({SQL["unused_scripts"]}), n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY unused_chars DESC, page_id) AS nth FROM u)
SELECT page_id, url, CASE WHEN split_part(split_part(url, '?', 1), '/', -1) = '' THEN url ELSE split_part(split_part(url, '?', 1), '/', -1) END AS label, unused_chars,
  floor(total_chars / 1000.0 * 10 + 0.5) / 10 AS kilobytes, CASE WHEN unused_pct >= 90 THEN 'severe' WHEN unused_pct >= 70 THEN 'high' ELSE 'moderate' END AS band FROM n WHERE nth = 1""")
def unused_files_view(spark: SparkSession, d: str) -> DataFrame:
    once = views.first_per_url(resources.unused_scripts(coverage(spark, d, "js")), F.desc("unused_chars"), "page_id")
    return once.select("page_id", "url", views.file_label(F.col("url")).alias("label"), "unused_chars", views.kilobytes(F.col("total_chars")).alias("kilobytes"), views.unused_band(F.col("unused_pct")).alias("band"))


@query(f"""
SELECT page_id, CASE WHEN html_to_text_ratio > 30 THEN 'very_high' WHEN html_to_text_ratio > 15 THEN 'high' WHEN html_to_text_ratio > 5 THEN 'fair' ELSE 'good' END AS band,
  floor(html_bytes / 1000.0 * 10 + 0.5) / 10 AS kilobytes FROM ({_TEXT_METRICS})""")
def metric_bands(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.text_metrics(pages(spark, d))
    return m.select("page_id", views.ratio_band(F.col("html_to_text_ratio")).alias("band"), views.kilobytes(F.col("html_bytes")).alias("kilobytes"))


@query(f"""
WITH t AS ({SQL["resource_totals"]}), m AS (SELECT t.*, c.css_chars FROM ({_TEXT_METRICS}) t JOIN ({_CSS_METRICS}) c USING (page_id)),
w AS (SELECT m.*, coalesce(j.chars, 0) AS jc, coalesce(j.app_chars, 0) AS ja, coalesce(c.chars, 0) AS cc FROM m LEFT JOIN t j ON j.page_id = m.page_id AND j.kind = 'js' LEFT JOIN t c ON c.page_id = m.page_id AND c.kind = 'css')
SELECT page_id, floor(jc / greatest(visible_chars, 1) * 100 + 0.5) / 100 AS js_to_text, floor(ja / greatest(visible_chars, 1) * 100 + 0.5) / 100 AS js_app_to_text, floor((cc + css_chars) / greatest(visible_chars, 1) * 100 + 0.5) / 100 AS css_to_text FROM w""")
def resource_ratios(spark: SparkSession, d: str) -> DataFrame:
    full = views.enriched_metrics(metrics.page_metrics(pages(spark, d), DOMAIN), resources.resource_totals(page_resources(spark, d)))
    return full.select("page_id", "js_to_text", "js_app_to_text", "css_to_text")


# --- locating sources -----------------------------------------------------------------------

_TARGETS = [("^https?://(?:m|media)[.]", "mobile"), ("/(?:product|item)", "product"), ("^https?://dir[.]", "directory")]


@query("""
SELECT page_id, CASE WHEN regexp_matches(lower(coalesce(url, '')), '^https?://(?:m|media)[.]') THEN 'mobile' WHEN regexp_matches(lower(coalesce(url, '')), '/(?:product|item)') THEN 'product'
  WHEN regexp_matches(lower(coalesce(url, '')), '^https?://dir[.]') THEN 'directory' ELSE 'default' END AS target FROM pages""")
def repo_targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", locate.repo_target(F.col("url"), _TARGETS, "default").alias("target"))


_STOP = rule_sql._list(locate.PATH_STOP_WORDS)


@query(f"""
WITH p AS (SELECT page_id, unnest(list_filter(string_split(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x))) AS part FROM pages),
t AS (SELECT page_id, part AS token FROM p UNION SELECT page_id, regexp_replace(part, '[-_]+', '', 'g') FROM p WHERE length(regexp_replace(part, '[-_]+', '', 'g')) > 3)
SELECT DISTINCT page_id, token FROM t""")
def url_path_tokens(spark: SparkSession, d: str) -> DataFrame:
    return text.each(table(spark, d, "pages"), locate.path_tokens(F.col("url")), "token", "page_id")


@query()
def snippet_file_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The findings of all criteria that have a snippet, each against the distinct files of all pages."""
    files = locate.distinct_files(page_resources(spark, d))
    return locate.candidate_files(model_issues(spark, d), table(spark, d, "pages"), files)


#: A small project for every page: its files, and what is reached from its view.
_PROJECT = {
    "app/routes.js": "import shell from './shell'\nimport other from './other'\nimport view from './view'", "app/shell.js": "import card from '../parts/card'", "app/other.js": "nothing here",
    "app/view.js": "import head from '../parts/head'", "parts/head.js": "import deep from './deep'", "parts/deep.js": "className='panel-wide'", "parts/card.js": '<div data-slot="left">', "parts/lone.js": "panel-wide",
}
_CLOSURE = [
    ("app/routes.js", "app/shell.js", 1), ("app/routes.js", "app/other.js", 1), ("app/routes.js", "app/view.js", 1), ("app/routes.js", "parts/card.js", 2), ("app/routes.js", "parts/head.js", 2),
    ("app/shell.js", "parts/card.js", 1), ("app/view.js", "parts/head.js", 1), ("app/view.js", "parts/deep.js", 2), ("parts/head.js", "parts/deep.js", 1),
]
_EXPANDED = [("app/view.js", 1, "search"), ("parts/deep.js", 2, "imported"), ("parts/card.js", 3, "inner")]


def _projects(spark: SparkSession, d: str) -> DataFrame:
    files = F.array(*[F.struct(F.lit(path).alias("path"), F.lit(content).alias("content")) for path, content in _PROJECT.items()])
    rows = table(spark, d, "pages").select("page_id", F.explode(files).alias("f"))
    return rows.select("page_id", F.concat(F.lit("site"), F.col("page_id").cast("string"), F.lit("/"), F.col("f.path")).alias("path"), "f.content")


@query("SELECT 'site' || page_id || '/' || a AS src, 'site' || page_id || '/' || b AS dst, d AS depth FROM pages, (VALUES " + ", ".join(f"('{a}', '{b}', {n})" for a, b, n in _CLOSURE) + ") t(a, b, d)")
def import_closure(spark: SparkSession, d: str) -> DataFrame:
    return locate.reachable(locate.import_edges(_projects(spark, d)))


@query("SELECT page_id AS issue_id, 'site' || page_id || '/' || p AS path, r AS rank, h AS how FROM pages, (VALUES " + ", ".join(f"('{p}', {r}, '{h}')" for p, r, h in _EXPANDED) + ") t(p, r, h)")
def expanded_candidates(spark: SparkSession, d: str) -> DataFrame:
    """From the view of every planted project to the files around it that its snippet names."""
    projects = _projects(spark, d)
    start = projects.filter(F.col("path").endswith("app/view.js")).select(F.col("page_id").alias("issue_id"), "path", F.lit(1).alias("rank"))
    issues = start.select("issue_id", F.lit('<p class="panel-wide x" data-slot="LEFT">t</p>').alias("html_snippet"))
    return neighbours.expanded_candidates(start, issues, locate.import_edges(projects), projects).select("issue_id", "path", "rank", "how")


@query()
def patch_places(spark: SparkSession, d: str) -> DataFrame:
    """Where in its first candidate file each finding may be mended."""
    files, issues = locate.distinct_files(page_resources(spark, d)), model_issues(spark, d)
    found = locate.candidate_files(issues, table(spark, d, "pages"), files)
    return neighbours.patch_places(found, issues, files).select("issue_id", "path", F.size("anchors").alias("n_anchors"), F.md5("excerpt").alias("digest"))


# --- jobs, lists, notes -----------------------------------------------------------------------


@query("""
WITH l AS (SELECT job_id, item_no, max(struct_pack(u := updated_at, s := item_status, e := error)) AS s FROM bulk_items GROUP BY 1, 2)
SELECT job_id, count(*) AS n_items, count(*) FILTER (s.s = 'done') AS n_done, count(*) FILTER (s.s = 'failed') AS n_failed,
  CAST(floor(count(*) FILTER (s.s IN ('done', 'failed')) / count(*) * 100 + 0.5) AS INTEGER) AS pct FROM l GROUP BY 1""")
def bulk_progress(spark: SparkSession, d: str) -> DataFrame:
    return views.job_progress(table(spark, d, "bulk_items"))


@query("""
WITH r AS (SELECT job_id, created_at AS b, updated_at AS e FROM bulk_items WHERE created_at IS NOT NULL AND updated_at IS NOT NULL),
n AS (SELECT *, CASE WHEN b > 1000 + max(e) OVER (PARTITION BY job_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM r),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY job_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT job_id, min(b) AS "begin", max(e) AS "end" FROM g GROUP BY job_id, run""")
def range_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bulk_items").select("job_id", F.col("created_at").alias("begin"), F.col("updated_at").alias("end")).dropna()
    return locate.merge_ranges(rows, "job_id", 1000)


@query("""
WITH l AS (SELECT job_id, max(updated_at) AS last_update FROM bulk_items GROUP BY 1)
SELECT * FROM l WHERE (SELECT max(updated_at) FROM bulk_items) - last_update <= 1800000""")
def live_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The jobs still kept at the time of the last update of all."""
    items = table(spark, d, "bulk_items")
    now = items.agg(F.max("updated_at")).first()[0]
    return views.live_jobs(items, F.lit(now).cast("bigint"), Settings.of(spark).job_keep_ms)


@query("SELECT page_id, substring(regexp_replace(regexp_replace(coalesce(url, ''), '(?i)https?://', ''), '[^A-Za-z0-9_.-]', '_', 'g'), 1, 40) AS slug FROM pages")
def report_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", views.file_slug(F.col("url")).alias("slug"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1), ''), url) AS label FROM pages")
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", views.host_label(F.col("url")).alias("label"))


@query(f"""
WITH c AS (SELECT regexp_replace(regexp_replace(unnest(string_split(url, ',')), {_T}, '', 'g'), '^["'']|["'']$', '', 'g') AS url FROM bulk_items)
SELECT DISTINCT url FROM c WHERE regexp_matches(url, '^https?://[^\\s/?#]+') AND NOT regexp_matches(url, '^https?://[^/?#]*[\\s<>]')""")
def csv_urls(spark: SparkSession, d: str) -> DataFrame:
    return views.urls_of_lines(table(spark, d, "bulk_items"), "url", ["job_id", "item_no"]).select("url")


@query("""
SELECT page_id, CASE WHEN url IS NULL OR NOT regexp_matches(url, '(?i)^https?://') THEN 'bad_address' WHEN html IS NULL THEN 'no_html' WHEN length(html) < 100 THEN 'too_small'
  WHEN length(html) > 10485760 THEN 'too_large' ELSE 'ok' END AS verdict FROM pages""")
def fetch_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return views.fetch_verdicts(table(spark, d, "pages"))


@query("SELECT feedback_id, message, CAST(try_cast(created_at AS TIMESTAMPTZ) AS VARCHAR) IS NOT NULL AS dated FROM feedback_notes WHERE feedback_id IS NOT NULL AND message IS NOT NULL")
def feedback_listing(spark: SparkSession, d: str) -> DataFrame:
    return views.feedback_listing(table(spark, d, "feedback_notes")).select("feedback_id", "message", F.col("created_at").isNotNull().alias("dated"))


@query("SELECT strftime(date_trunc('hour', ingested_at), '%Y-%m-%d %H:00') AS hour, host, count(*) AS n_pages FROM pages WHERE ingested_at IS NOT NULL GROUP BY ALL")
def hourly_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The windowed count of the stream, over the whole table at once."""
    per = streaming.hourly_arrivals(table(spark, d, "pages").withColumn("ingested_at", F.col("ingested_at").cast("timestamp")))
    return per.select(F.date_format("hour.start", "yyyy-MM-dd HH:00").alias("hour"), "host", "n_pages")
