"""The deterministic audit rules as column expressions.

Every rule is an array of snippets, one for each issue it raises on the page, under a
rule id, a criterion and a severity. Counts, scores and issue rows all derive from it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.patterns import java
from sitegauge.functions.text import INERT, blank, count, each, find_all, first, has, shorten, trim_all, units

ERROR, WARNING, INFO = "error", "warning", "info"
CRITERIA = ("llm_friendly", "w3c", "seo", "semantic", "accessibility")

# Fixed values of the rules.
GENERIC_ANCHORS = ("click here", "read more", "here", "more", "learn more", "details", "view", "link")
DEPRECATED = ("font", "center", "marquee", "blink", "basefont", "big", "strike", "tt", "frame", "frameset")
UNLABELLED_SKIPS = ("hidden", "submit", "button", "reset", "image")
PLACEHOLDER_SKIPS = ("hidden", "submit", "button", "reset")
SEMANTIC_TAGS = ("main", "nav", "header", "footer", "section", "article", "aside", "figure")
LANDMARKS = (("main", ERROR), ("header", WARNING), ("footer", WARNING), ("nav", WARNING))
ALLOWED_CHILDREN = {
    "dl": ("dt", "dd", "script", "template"),
    "ul": ("li", "script", "template"),
    "ol": ("li", "script", "template"),
    "select": ("option", "optgroup", "script", "template"),
    "thead": ("tr", "script", "template"),
    "tbody": ("tr", "script", "template"),
    "tfoot": ("tr", "script", "template"),
    "tr": ("td", "th", "script", "template"),
}
#: What a finding says, and what it advises.
TEXTS = {
    "L01": ("no first-rank heading", "Give the page one heading of the first rank that names its subject."),
    "L02": ("several first-rank headings", "Keep one heading of the first rank and lower the others."),
    "L03": ("heading rank skipped", "Go down one rank at a time."),
    "L04": ("no main landmark", "Put the content that only this page has into main."),
    "L05": ("no nav landmark", "Put the links around the site into nav."),
    "L06": ("link text says nothing", "Say in the link text where it leads."),
    "L07": ("empty link", "Give the link a text, or take it out."),
    "L08": ("images without description", "Describe every picture in alt; leave alt empty where it only decorates."),
    "L09": ("clickable div without role", "Use a button, or give the element the role of one and make it reachable by keyboard."),
    "L10": ("layout table", "Lay the page out with styles and keep tables for data."),
    "L10b": ("several layout tables", "Replace the other layout tables as well."),
    "L11": ("deep wrapper nesting", "Take out wrappers that carry no meaning."),
    "W01": ("element not allowed as direct child", "Move the element to where the content model allows it."),
    "W02": ("identifier used twice", "Give every element an identifier of its own."),
    "W03": ("deprecated element", "Replace the element by styles or by one that is still in use."),
    "W04": ("link within link", "Close the first link before the next one begins."),
    "W05": ("button within link", "Use either a link or a button, not one within the other."),
    "W06": ("block within paragraph", "Close the paragraph before the block begins."),
    "W07": ("images without required description", "Add the alt attribute to every picture."),
    "W08": ("several main elements", "Keep one main element."),
    "S01": ("no title", "Add a title to the head."),
    "S02": ("title too short", "Write a title of ten characters or more."),
    "S03": ("title too long", "Shorten the title to 65 characters."),
    "S04": ("no description", "Add a description to the head."),
    "S05": ("description too short", "Write a description of 70 characters or more."),
    "S06": ("description too long", "Shorten the description to 165 characters."),
    "S07": ("no canonical address", "Name the page's own address in a canonical link."),
    "S08": ("no viewport", "Add the viewport for small screens."),
    "S09": ("no first-rank heading to rank by", "Add a heading of the first rank with the words people search for."),
    "S10": ("several first-rank headings to rank by", "Keep one heading of the first rank."),
    "S11": ("no structured data", "Add structured data about what the page shows."),
    "S12": ("images without searchable description", "Describe the pictures so that they can be found."),
    "S13": ("indexing switched off", "Take noindex out if the page is to be found."),
    "S14": ("no sharing card", "Add the tags that shared links are shown with."),
    "S15": ("several languages without alternates", "Link the versions in other languages."),
    "M01": ("element not allowed as direct child", "Move the element to where the content model allows it."),
    "M03": ("several main elements", "Keep one main element."),
    "M04": ("section without heading", "Begin the section with a heading, or use a plain box."),
    "M04b": ("several sections without heading", "Give the other sections a heading too."),
    "M05": ("article without heading", "Begin the article with a heading."),
    "M06": ("menu without list", "Put the links of the menu into a list."),
    "M07": ("empty container", "Fill the container or take it out."),
    "M08": ("boxes outnumber elements with meaning", "Use elements with meaning in place of boxes."),
    "A01": ("page language not declared", "Declare the language of the page on the html element."),
    "A02": ("no document title", "Give the document a title."),
    "A03": ("images without alternative text", "Write an alternative text for every picture."),
    "A04": ("input without label", "Tie a label to the input or name it with aria-label."),
    "A05": ("many inputs without label", "Label all inputs of the page."),
    "A06": ("placeholder as only label", "Add a label; a placeholder goes away as soon as something is typed."),
    "A07": ("positive tab position", "Let the order of the page set the order of the keyboard."),
    "A08": ("new tab link keeps its opener", "Add noopener to links that open a new tab."),
    "A09": ("button without name", "Give the button a text or a label."),
    "A10": ("hidden element takes focus", "Do not hide from readers what the keyboard can reach."),
    "A11": ("data tables without header cells", "Mark header cells as such."),
    "A12": ("no skip link", "Begin with a link that skips to the content."),
    "M02_main": ("no main landmark", "Mark the main of the page as one."),
    "M02_header": ("no header landmark", "Mark the header of the page as one."),
    "M02_footer": ("no footer landmark", "Mark the footer of the page as one."),
    "M02_nav": ("no nav landmark", "Mark the nav of the page as one."),
}
P = {
    "head": r"<head\b[^>]*>[\s\S]*?<\/head>",
    "heading": r"<h([1-6])\b[^>]*>",
    "img": r"<img\b[^>]*>",
    "alt": r"\balt\s*=",
    "empty_anchor": r"<a\b[^>]*>\s*<\/a>",
    "onclick_div": r"<div\b[^>]*\bonclick\b[^>]*>",
    "button_role": r"role\s*=\s*[\"']button[\"']",
    "table": r"<table\b[\s\S]*?<\/table>",
    "deep": r"(?:<div\b[^>]*>\s*){6,60}",
    "id": r"\bid\s*=\s*[\"']([^\"']+)[\"']",
    "two_anchors": r"<a\b[^>]*>[\s\S]*?<a\b[^>]*>",
    "anchor_button": r"<a\b[^>]*>[\s\S]*?<button\b[^>]*>",
    "block_in_p": r"<p\b[^>]*>[\s\S]*?<(?:div|section|article|ul|ol|table|h[1-6]|blockquote|pre|figure)\b",
    "title": r"<title\b[^>]*>([\s\S]*?)<\/title>",
    "description": r"<meta\b[^>]*\bname\s*=\s*[\"']description[\"'][^>]*>",
    "content": r"\bcontent\s*=\s*[\"']([^\"']*)[\"']",
    "canonical": r"<link\b[^>]*\brel\s*=\s*[\"']canonical[\"'][^>]*>",
    "viewport": r"<meta\b[^>]*\bname\s*=\s*[\"']viewport[\"'][^>]*>",
    "json_ld": r"<script\b[^>]*\btype\s*=\s*[\"']application\/ld\+json[\"'][^>]*>",
    "robots": r"<meta\b[^>]*\bname\s*=\s*[\"']robots[\"'][^>]*>",
    "card": r"<meta\b[^>]*\bname\s*=\s*[\"']twitter:card[\"'][^>]*>",
    "lang": r"\blang\s*=\s*[\"']([^\"']+)[\"']",
    "hreflang": r"<link\b[^>]*\bhreflang\b",
    "section": r"<section\b[\s\S]*?<\/section>",
    "article": r"<article\b[\s\S]*?<\/article>",
    "nav": r"<nav\b[\s\S]*?<\/nav>",
    "empty_container": r"<(?:main|section|article|aside)\b[^>]*>\s*<\/(?:main|section|article|aside)>",
    "html": r"<html\b[^>]*>",
    "some_title": r"<title\b[^>]*>[^<]+<\/title>",
    "label_for": r"<label\b[^>]*\bfor\s*=\s*[\"']([^\"']+)[\"'][^>]*>",
    "input": r"<input\b[^>]*>",
    "placeholder_input": r"<input\b[^>]*\bplaceholder\s*=[^>]*>",
    "type": r"\btype\s*=\s*[\"']([^\"']*)[\"']",
    "input_id": r"\bid\s*=\s*[\"']([^\"']*)[\"']",
    "aria": r"\baria-(?:label|labelledby)\s*=\s*[\"'][^\"']+[\"']",
    "tabindex": r"\btabindex\s*=\s*[\"'][1-9][0-9]*[\"']",
    "new_tab": r"<a\b[^>]*\btarget\s*=\s*[\"']_blank[\"'][^>]*>",
    "noopener": r"rel\s*=\s*[\"'][^\"']*noopener",
    "empty_button": r"<button\b[^>]*>\s*<\/button>",
    "aria_label": r"aria-label\s*=",
    "hidden_focus": r"<(?:a|button|input|select|textarea)\b[^>]*\baria-hidden\s*=\s*[\"']true[\"'][^>]*>",
    "skip_link": r"<a\b[^>]*href\s*=\s*[\"']#(?:main|content|skip|maincontent)[^\"']*[\"'][^>]*>",
    "tag": r"<\/?[a-zA-Z][a-zA-Z0-9-]*\b[^>]*>",
    "tag_name": r"<\/?([a-zA-Z][a-zA-Z0-9-]*)\b",
}


def parent_span(tag: str) -> str:
    return rf"<{tag}\b[^>]*>([\s\S]*?)<\/{tag}>"


def open_tag(tag: str) -> str:
    return rf"<{tag}\b"


class Rule(NamedTuple):
    rule_id: str
    criterion: str
    severity: str
    snippets: Column
    #: how many places of the page the finding is about, where they are more than the snippets
    total: Column | None


def with_facts(pages: DataFrame) -> DataFrame:
    """The columns every rule draws on, each computed once: pages without html are left out."""
    html = F.col("html")
    facts = pages.filter("html is not null").withColumns({"structure": blank(html, INERT), "head": first(html, P["head"])})
    counts = {f"n_{t}": count(F.col("structure"), open_tag(t)) for t in ("h1", "div", "span", *SEMANTIC_TAGS)}
    facts = facts.withColumns(counts)
    facts = facts.withColumns(
        {
            "images": F.filter(find_all(html, P["img"]), lambda t: ~has(t, P["alt"])),
            "tables": F.slice(find_all(html, P["table"]), 1, 5),
            "labels": find_all(html, P["label_for"], 1),
            "levels": F.transform(find_all(html, P["heading"], 1), lambda x: x.cast("int")),
            "ids": F.transform(find_all(html, P["id"], 1), F.lower),
            "body_tag": F.coalesce(F.nullif(first(html, r"(?-i)<body\b[^>]*>"), F.lit("")), F.lit("<body>")),
        }
    )
    return facts.withColumns(
        {
            "layout": F.filter("tables", lambda t: has(t, open_tag("td")) & ~has(t, open_tag("th")) & ~has(t, open_tag("thead"))),
            "headless": F.filter("tables", lambda t: has(t, open_tag("td")) & ~has(t, open_tag("th"))),
            "plain_sections": F.filter(F.slice(find_all(html, P["section"]), 1, 10), lambda t: ~has(t, r"<h[1-6]\b")),
            "lonely": _unlabelled(F.slice(find_all(html, P["input"]), 1, 30), UNLABELLED_SKIPS),
            "sorted_ids": F.array_sort("ids"),
        }
    )


def _unlabelled(inputs: Column, skips: tuple[str, ...]) -> Column:
    labels = F.col("labels")

    def bare(t: Column) -> Column:
        name = first(t, P["input_id"], 1)
        return ~F.lower(first(t, P["type"], 1)).isin(*skips) & ~has(t, P["aria"]) & ((name == "") | ~F.array_contains(labels, name))

    return F.filter(inputs, bare)


def _none() -> Column:
    return F.array().cast("array<string>")


def _if(condition: Column, snippet: Column | str) -> Column:
    return F.when(condition, F.array(F.lit(snippet) if isinstance(snippet, str) else snippet)).otherwise(_none())


def _cap(c: Column, most: int) -> Column:
    return F.slice(c, 1, most)


def _one(c: Column) -> Column:
    """The first element as a list of one, or nothing."""
    return F.slice(c, 1, 1)


def child_violations(html: Column) -> Column:
    """Distinct ``struct<parent, child, span>`` by parent, child and the first 300 characters of elements directly inside a parent that forbids them.

    A parent ends at the first closing tag of its name; any tag that is not self-closed
    deepens the walk, void ones too; a closing tag never takes it below the top.
    """
    def of(parent: str, allowed: tuple[str, ...]) -> Column:
        def step(state: Column, tag: Column) -> Column:
            name = F.lower(first(tag, P["tag_name"], 1))
            closing = tag.startswith("</")
            bad = ~closing & (state["depth"] == 0) & ~name.isin(*allowed)
            depth = F.when(closing, F.greatest(F.lit(0), state["depth"] - 1)).otherwise(state["depth"] + F.when(tag.endswith("/>"), 0).otherwise(1))
            return F.struct(depth.cast("int").alias("depth"), F.when(bad, F.concat(state["bad"], F.array(name))).otherwise(state["bad"]).alias("bad"))

        def walk(span: Column) -> Column:
            begin = F.struct(F.lit(0).alias("depth"), _none().alias("bad"))
            tags = find_all(first(span, parent_span(parent), 1), P["tag"])
            children = F.aggregate(tags, begin, step, lambda s: F.array_distinct(s["bad"]))
            shown = F.regexp_replace(span, java(r"\s+"), " ")
            key, shown = F.substring(shown, 1, 300), F.substring(shown, 1, 400)
            return F.transform(children, lambda child: F.struct(F.lit(parent).alias("parent"), child.alias("child"), key.alias("key"), shown.alias("span")))

        spans = F.when(has(html, open_tag(parent)), find_all(html, parent_span(parent))).otherwise(_none())
        return F.flatten(F.transform(spans, walk))

    found = F.array_distinct(F.concat(*[of(p, a) for p, a in ALLOWED_CHILDREN.items()]))
    key = lambda v: F.struct(v["parent"], v["child"], v["key"])

    def first_of_key(all_: Column) -> Column:
        return F.filter(all_, lambda v, k: ~F.exists(F.slice(all_, 1, k), lambda w: key(w) == key(v)))

    # a lambda over a list of one binds the list, so that it is evaluated once
    return F.transform(F.array(found), lambda all_: F.when(F.size(F.array_distinct(F.transform(all_, key))) == F.size(all_), all_).otherwise(first_of_key(all_)))[0]


def rules() -> list[Rule]:
    html, head, body = F.col("html"), F.col("head"), F.col("body_tag")
    n = {t: F.col(f"n_{t}") for t in ("h1", "div", "span", *SEMANTIC_TAGS)}
    images = F.col("images")
    out: list[Rule] = []

    def add(rule_id: str, criterion: str, severity: str, snippets: Column, total: Column | None = None) -> None:
        out.append(Rule(rule_id, criterion, severity, snippets, total))

    def few(c: Column, most: int) -> Column:
        return F.least(F.size(c), F.lit(most))

    # columns, not expressions: what a lambda holds is evaluated anew for every element
    levels, ids = F.col("levels"), F.col("ids")
    jumps = F.filter(F.transform(levels, lambda a, k: F.struct(a.alias("a"), F.get(levels, k + 1).alias("b"))), lambda s: s["b"] > s["a"] + 1)
    layout, plain_sections, lonely, headless = F.col("layout"), F.col("plain_sections"), F.col("lonely"), F.col("headless")
    area = "llm_friendly"
    add("L01", area, ERROR, _if(n["h1"] == 0, body))
    add("L02", area, WARNING, _if(n["h1"] > 1, shorten(first(html, r"<h1\b[^>]*>[\s\S]*?<\/h1>"))), n["h1"])
    add("L03", area, WARNING, F.transform(_cap(jumps, 3), lambda s: F.format_string("h%d > h%d", s["a"], s["b"])))
    add("L04", area, ERROR, _if(n["main"] == 0, body))
    add("L05", area, WARNING, _if(n["nav"] == 0, body))
    generic = [first(html, rf"<a\b[^>]*>\s*{text}\s*<\/a>") for text in GENERIC_ANCHORS]
    add("L06", area, WARNING, F.transform(F.filter(F.array(*generic), lambda s: s != ""), lambda t: shorten(t)))
    add("L07", area, ERROR, F.transform(_cap(find_all(html, P["empty_anchor"]), 3), lambda t: shorten(t)))
    add("L08", area, ERROR, F.transform(_one(images), lambda t: shorten(t)), few(images, 5))
    clickable = _cap(find_all(html, P["onclick_div"]), 2)
    add("L09", area, WARNING, F.transform(F.filter(clickable, lambda t: ~has(t, P["button_role"])), lambda t: shorten(t)))
    add("L10", area, WARNING, F.transform(_one(layout), lambda t: shorten(t, 250)), F.size(layout))
    add("L10b", area, INFO, _if(F.size(layout) > 1, "<table>…</table>"), F.size(layout))
    add("L11", area, INFO, F.transform(_one(F.array_remove(F.array(first(html, P["deep"])), "")), lambda t: shorten(t, 250)))

    area = "w3c"
    violations = F.transform(F.col("violations"), lambda v: v["span"])
    twice = F.array_distinct(F.filter(F.col("sorted_ids"), lambda i, k: i == F.get(F.col("sorted_ids"), k + 1)))
    repeated = F.transform(F.array(twice), lambda r: F.when(F.size(r) > 1, F.filter(F.array_distinct(ids), lambda i: F.array_contains(r, i))).otherwise(r))[0]
    add("W01", area, ERROR, violations)
    add("W02", area, ERROR, F.transform(repeated, lambda i: F.concat(F.lit('id="'), i, F.lit('"'))))
    old = [first(html, rf"<{t}\b[^>]*>") for t in DEPRECATED]
    add("W03", area, ERROR, F.transform(F.filter(F.array(*old), lambda s: s != ""), lambda t: shorten(t)))
    add("W04", area, ERROR, F.transform(_cap(find_all(html, P["two_anchors"]), 2), lambda t: shorten(t, 250)))
    buttons = F.when(has(html, open_tag("button")), find_all(html, P["anchor_button"])).otherwise(_none())
    add("W05", area, ERROR, F.transform(_cap(buttons, 2), lambda t: shorten(t, 250)))
    add("W06", area, ERROR, F.transform(_cap(find_all(html, P["block_in_p"]), 3), lambda t: shorten(t, 250)))
    add("W07", area, ERROR, F.transform(_one(images), lambda t: shorten(t)), few(images, 5))
    add("W08", area, ERROR, _if(n["main"] > 1, "<main>"), n["main"])

    area = "seo"
    missing = "<head>…</head>"
    title_tag = first(head, P["title"])
    title = trim_all(F.regexp_replace(first(head, P["title"], 1), "<[^>]+>", ""))
    description_tag = first(head, P["description"])
    description = trim_all(first(description_tag, P["content"], 1))
    robots = first(head, P["robots"])
    languages = F.array_distinct(F.transform(_cap(find_all(html, P["lang"], 1), 10), F.lower))
    add("S01", area, ERROR, _if(title_tag == "", missing))
    add("S02", area, ERROR, _if((title_tag != "") & (units(title) < 10), shorten(title_tag)))
    add("S03", area, WARNING, _if((title_tag != "") & (units(title) > 65), shorten(title_tag)))
    add("S04", area, ERROR, _if(description_tag == "", missing))
    add("S05", area, WARNING, _if((description_tag != "") & (units(description) < 70), shorten(description_tag)))
    add("S06", area, INFO, _if((description_tag != "") & (units(description) > 165), shorten(description_tag)))
    add("S07", area, WARNING, _if(~has(head, P["canonical"]), missing))
    add("S08", area, ERROR, _if(~has(head, P["viewport"]), missing))
    add("S09", area, ERROR, _if(n["h1"] == 0, body))
    add("S10", area, WARNING, _if(n["h1"] > 1, "<h1>"), n["h1"])
    add("S11", area, WARNING, _if(~has(html, P["json_ld"]), missing))
    add("S12", area, WARNING, F.transform(_one(images), lambda t: shorten(t)), few(images, 3))
    add("S13", area, ERROR, _if(first(robots, P["content"], 1).rlike("(?i)noindex"), shorten(robots)))
    add("S14", area, INFO, _if(~has(head, P["card"]), missing))
    add("S15", area, INFO, _if((F.size(languages) > 1) & ~has(head, P["hreflang"]), missing))

    area = "semantic"
    any_heading = r"<h[1-6]\b"
    plain_articles = F.filter(_cap(find_all(html, P["article"]), 5), lambda t: ~has(t, any_heading))
    plain_navs = F.filter(_cap(find_all(html, P["nav"]), 3), lambda t: ~has(t, r"<[uo]l\b"))
    boxes = n["div"] + n["span"]
    meaningful = sum((n[t] for t in SEMANTIC_TAGS[1:]), n[SEMANTIC_TAGS[0]])
    add("M01", area, ERROR, violations)
    for tag, severity in LANDMARKS:
        add(f"M02_{tag}", area, severity, _if(n[tag] == 0, body))
    add("M03", area, ERROR, _if(n["main"] > 1, "<main>"), n["main"])
    add("M04", area, WARNING, F.transform(_one(plain_sections), lambda t: shorten(t, 250)), F.size(plain_sections))
    add("M04b", area, INFO, _if(F.size(plain_sections) > 1, "<section>…</section>"), F.size(plain_sections))
    add("M05", area, WARNING, F.transform(_one(plain_articles), lambda t: shorten(t, 250)))
    add("M06", area, INFO, F.transform(_one(plain_navs), lambda t: shorten(t, 250)))
    add("M07", area, ERROR, F.transform(_cap(find_all(html, P["empty_container"]), 3), lambda t: shorten(t)))
    add("M08", area, WARNING, _if((boxes > 50) & (meaningful < F.floor(boxes * F.lit(0.1))), "<div>…</div>"))

    area = "accessibility"
    html_tag = first(html, P["html"])

    hinted = _unlabelled(_cap(find_all(html, P["placeholder_input"]), 20), PLACEHOLDER_SKIPS)
    unsafe = F.filter(_cap(find_all(html, P["new_tab"]), 5), lambda t: ~has(t, P["noopener"]))
    mute = F.filter(_cap(find_all(html, P["empty_button"]), 3), lambda t: ~has(t, P["aria_label"]))
    add("A01", area, ERROR, _if((html_tag == "") | ~has(html_tag, P["lang"]), shorten(F.when(html_tag == "", "<html>").otherwise(html_tag))))
    add("A02", area, ERROR, _if(~has(html, P["some_title"]), missing))
    add("A03", area, ERROR, F.transform(_one(images), lambda t: shorten(t)), few(images, 5))
    add("A04", area, ERROR, F.transform(_cap(lonely, 3), lambda t: shorten(t)))
    add("A05", area, INFO, _if(F.size(lonely) > 3, "<input>"), F.size(lonely))
    add("A06", area, WARNING, F.transform(_one(hinted), lambda t: shorten(t)))
    add("A07", area, WARNING, _cap(find_all(html, P["tabindex"]), 2))
    add("A08", area, WARNING, F.transform(_one(unsafe), lambda t: shorten(t)))
    add("A09", area, ERROR, F.transform(mute, lambda t: shorten(t)))
    add("A10", area, ERROR, F.transform(_cap(find_all(html, P["hidden_focus"]), 2), lambda t: shorten(t)))
    add("A11", area, WARNING, F.transform(_one(headless), lambda t: shorten(t, 250)), F.size(headless))
    add("A12", area, INFO, _if(~has(html, P["skip_link"]) & (n["nav"] > 0), "<body>…</body>"))
    return out


def _fired(pages: DataFrame, criterion: str | None = None) -> DataFrame:
    """``page_id, fired``: the rules that fire on each page with html, as an array."""
    facts = with_facts(pages.select("page_id", "html"))
    wanted = [r for r in rules() if criterion in (None, r.criterion)]
    if criterion in (None, "w3c", "semantic"):
        facts = facts.withColumn("violations", child_violations(F.col("html")))
    every = F.array(*[F.struct(F.lit(r.criterion).alias("criterion"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), r.snippets.alias("snippets"), (F.lit(None).cast("int") if r.total is None else r.total.cast("int")).alias("total")) for r in wanted])
    return facts.select("page_id", F.filter(every, lambda f: F.size(f["snippets"]) > 0).alias("fired"))


def findings(pages: DataFrame, criterion: str | None = None) -> DataFrame:
    """``page_id, criterion, rule_id, severity, n, n_matches, snippets`` for every rule that fires on a page.

    ``n`` counts issues; ``n_matches`` is the number the finding tells, where that is another
    one. Narrow: one scan, no shuffle. A page without html has no findings.
    """
    rows = each(_fired(pages, criterion), F.col("fired"), "f", "page_id").select("page_id", "f.*")
    return rows.withColumn("n", F.size("snippets")).withColumn("n_matches", F.coalesce("total", "n")).drop("total")


def _texts(rule_id: Column, total: Column) -> tuple[Column, Column]:
    says = F.create_map(*[F.lit(x) for k, (t, _) in TEXTS.items() for x in (k, t)])
    advice = F.create_map(*[F.lit(x) for k, (_, t) in TEXTS.items() for x in (k, t)])
    number = F.when(total.isNotNull(), F.concat(F.lit(": "), total.cast("string"))).otherwise(F.lit(""))
    return F.concat(says[rule_id], number), advice[rule_id]


def issues(pages: DataFrame) -> DataFrame:
    """``page_id, criterion, rule_id, ord, severity, issue, recommendation, html_snippet``: one row per issue."""
    rows = each(_fired(pages), F.col("fired"), "f", "page_id").select("page_id", "f.*")
    says, advice = _texts(F.col("rule_id"), F.col("total"))
    told = rows.select("page_id", "criterion", "rule_id", "severity", says.alias("issue"), advice.alias("recommendation"), F.posexplode_outer("snippets").alias("ord", "html_snippet"))
    return told.select("page_id", "criterion", "rule_id", "ord", "severity", "issue", "recommendation", "html_snippet")


def reports(pages: DataFrame) -> DataFrame:
    """``page_id, overall_score, grade, criteria``: one report per page with html; ``criteria`` has
    ``criterion, score, issues`` of all five areas, ``issues`` in the order of the rules. Narrow."""
    fired = _fired(pages)

    def area(c: str) -> Column:
        own = F.filter("fired", lambda f: f["criterion"] == c)
        told = F.flatten(F.transform(own, lambda f: F.transform(f["snippets"], lambda snippet: F.struct(f["rule_id"].alias("rule_id"), f["severity"].alias("severity"), *[t.alias(n) for t, n in zip(_texts(f["rule_id"], f["total"]), ("issue", "recommendation"))], snippet.alias("html_snippet")))))
        return F.struct(F.lit(c).alias("criterion"), _criterion_score(c).alias("score"), told.alias("issues"))

    rows = fired.withColumn("lost", _lost()).select("page_id", F.array(*map(area, CRITERIA)).alias("criteria"))
    total = F.aggregate("criteria", F.lit(0), lambda a, c: a + c["score"])
    overall = F.floor(total / F.lit(5) + F.lit(0.5)).cast("int")
    return rows.select("page_id", overall.alias("overall_score"), grade(overall).alias("grade"), "criteria")


def score(errors: Column, warnings: Column, infos: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(92), 92 - 10 * errors - 4 * warnings - infos)).cast("int")


def _lost() -> Column:
    return F.transform("fired", lambda f: F.struct(f["criterion"].alias("c"), f["severity"].alias("s"), F.size(f["snippets"]).alias("n")))


def _criterion_score(criterion: str) -> Column:
    def total(severity: str) -> Column:
        return F.aggregate("lost", F.lit(0), lambda a, f: a + F.when((f["c"] == criterion) & (f["s"] == severity), f["n"]).otherwise(0))

    return score(*(total(s) for s in (ERROR, WARNING, INFO)))


def _scores(pages: DataFrame) -> DataFrame:
    """``page_id`` and a score column per criterion, folded from the page's own rules: no shuffle."""
    return _fired(pages).select("page_id", _lost().alias("lost")).select("page_id", *[_criterion_score(c).alias(c) for c in CRITERIA])


def criterion_scores(pages: DataFrame) -> DataFrame:
    """``page_id, criterion, score`` of every page with html; 92 where nothing fires."""
    pairs = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("score")) for c in CRITERIA])
    return each(_scores(pages), pairs, "p", "page_id").select("page_id", "p.*")


def grade(value: Column) -> Column:
    return F.when(value >= 80, "good").when(value >= 60, "fair").when(value >= 40, "poor").otherwise("bad")


def overall_scores(pages: DataFrame) -> DataFrame:
    """``page_id``, the five criterion scores, ``overall_score`` and ``grade``."""
    mean = F.floor(sum((F.col(c) for c in CRITERIA[1:]), F.col(CRITERIA[0])) / F.lit(5) + F.lit(0.5)).cast("int")
    return _scores(pages).withColumn("overall_score", mean).withColumn("grade", grade(F.col("overall_score")))
