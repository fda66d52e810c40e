"""From candidate files to the files around them, and to the places within a file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.functions.patterns import java
from sitegauge.functions.text import find_all, first, trim_all
from sitegauge.operators.locate import files_with_needles, reachable, search_needles

# How many files each kind of step may lead to.
MOST_IMPORTED, MOST_IMPORTERS, MOST_SIBLINGS, MOST_INNER = 14, 6, 24, 18
MOST_CANDIDATES = 8
IMPORTED, IMPORTER, SIBLING, INNER = "imported", "importer", "sibling", "inner"
_HOPS = (IMPORTED, IMPORTER, SIBLING, INNER)


def _up_to(rows: DataFrame, keys: list[str], by: list[str], most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return rows.withColumn("_at", place).filter(F.col("_at") <= most).drop("_at")


def importers(edges: DataFrame) -> DataFrame:
    """``dst, importers``: the files that import each file, in the order of their names."""
    return edges.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("importers"))


def surroundings(edges: DataFrame) -> DataFrame:
    """``start, path, how, via``: what a file's imports lead to, over ``src, dst``.

    ``imported`` within two steps; ``importer``, the files that import it; ``sibling``, what
    those import besides; ``inner``, what the siblings import within two steps. Each list
    is taken by depth and name up to its bound, and a file comes once, by the first of these.
    """
    ahead = reachable(edges, 2)
    near = ahead.select(F.col("src").alias("start"), F.col("dst").alias("path"), "depth")
    imported = _up_to(near, ["start"], ["depth", "path"], MOST_IMPORTED).select("start", "path", F.lit(IMPORTED).alias("how"), F.col("start").alias("via"))
    back = _up_to(edges.select(F.col("dst").alias("start"), F.col("src").alias("path")).filter("start <> path").distinct(), ["start"], ["path"], MOST_IMPORTERS)
    importer = back.select("start", "path", F.lit(IMPORTER).alias("how"), F.col("start").alias("via"))
    beside = back.withColumnRenamed("path", "via").join(edges.select(F.col("src").alias("via"), F.col("dst").alias("path")), "via").filter("path <> start")
    sibling = _up_to(beside, ["start", "via"], ["path"], MOST_SIBLINGS).select("start", "path", F.lit(SIBLING).alias("how"), "via")
    under = sibling.select("start", F.col("path").alias("via"), F.col("via").alias("_over")).join(ahead.select(F.col("src").alias("via"), F.col("dst").alias("path"), "depth"), "via").filter("path <> start and path <> _over")
    inner = _up_to(under, ["start", "_over", "via"], ["depth", "path"], MOST_INNER).select("start", "path", F.lit(INNER).alias("how"), "via")
    every = imported.unionByName(importer).unionByName(sibling).unionByName(inner)
    order = F.array_position(F.array(*map(F.lit, _HOPS)), F.col("how"))
    best = every.groupBy("start", "path").agg(F.min(F.struct(order.alias("o"), "via", "how")).alias("s"))
    return best.select("start", "path", "s.how", "s.via")


def snippet_probes(snippet: Column) -> Column:
    """What a file must hold one of to belong to a snippet: identifiers, longer class names, data
    attributes, long words, the beginning of the text, the title and the description."""
    quoted = r"\s*=\s*[\"']([^\"']+)[\"']"
    names = F.filter(F.flatten(F.transform(find_all(snippet, rf"\bclass{quoted}", 1), lambda v: F.split(v, r"\s+"))), lambda t: F.length(t) >= 4)
    data = F.transform(find_all(snippet, rf"\bdata-[a-zA-Z0-9-]+{quoted}"), lambda v: F.concat(F.regexp_extract(v, "^([^ \t\r\n=]+)", 1), F.lit('="'), F.regexp_extract(v, "[\"']([^\"']+)[\"']$", 1), F.lit('"')))
    text = snippet
    for hidden in (r"<script[\s\S]*?<\/script>", r"<style[\s\S]*?<\/style>", "<[^>]+>", "&nbsp;", r"\s+"):
        text = F.regexp_replace(text, java(hidden), " ")
    text = trim_all(text)
    words = F.filter(F.split(text, " "), lambda w: F.length(w) >= 12)
    title = F.substring(trim_all(first(snippet, r"<title[^>]*>([^<]{8,500})<\/title>", 1)), 1, 200)
    description = F.substring(trim_all(first(snippet, r"<meta[^>]*\bname\s*=\s*[\"']description[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']{12,800})[\"']", 1)), 1, 220)
    single = F.array(F.when(F.length(text) >= 20, F.substring(text, 1, 120)).otherwise(F.lit("")), title, description)
    return F.array_distinct(F.filter(F.concat(find_all(snippet, rf"\bid{quoted}", 1), names, data, words, single), lambda p: p != ""))


def expanded_candidates(candidates: DataFrame, issues: DataFrame, edges: DataFrame, files: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """``issue_id, path, rank, how, via``: the candidates (``issue_id, path, rank``) of each issue, then
    the files around them that hold one of the probes of its snippet, up to ``most`` in all.

    Those that fewer and nearer steps lead to come first. A file's text travels once for
    every sixteenth of the issues that reach it. Nulls reach nothing; an issue without
    candidates stays without.
    """
    own = candidates.select("issue_id", "path", "rank")
    reached = own.select("issue_id", F.col("path").alias("start"), F.col("rank").alias("of")).join(surroundings(edges), "start")
    reached = reached.join(own.select("issue_id", "path"), ["issue_id", "path"], "left_anti")
    order = F.array_position(F.array(*map(F.lit, _HOPS)), F.col("how"))
    nearest = reached.groupBy("issue_id", "path").agg(F.min(F.struct(F.when(F.col("how") == IMPORTED, 1).otherwise(2).alias("turn"), "of", order.alias("o"), "via", "how")).alias("s"))
    asked = nearest.join(issues.select("issue_id", F.transform(snippet_probes(F.col("html_snippet")), lambda p: F.lower(p)).alias("probes")), "issue_id")
    of_file = asked.groupBy("path", F.pmod(F.xxhash64("issue_id"), F.lit(16)).alias("_part")).agg(F.collect_list(F.struct("issue_id", "s", "probes")).alias("_a"))
    texts = files.groupBy("path").agg(F.first("content").alias("content")).select("path", F.lower("content").alias("_c"))
    hit = of_file.join(texts, "path").select("path", F.explode(F.filter("_a", lambda a: F.exists(a["probes"], lambda p: F.contains(F.col("_c"), p)))).alias("a"))
    found = hit.select("a.issue_id", "path", "a.s.*")
    added = found.withColumn("_at", F.row_number().over(Window.partitionBy("issue_id").orderBy("turn", "of", "o", "via", "path")))
    taken = own.groupBy("issue_id").agg(F.max("rank").alias("_n"))
    added = added.join(taken, "issue_id").select("issue_id", "path", (F.col("_n") + F.col("_at")).cast("int").alias("rank"), "how", "via").filter(F.col("rank") <= most)
    return own.select("issue_id", "path", F.col("rank").cast("int").alias("rank"), F.lit("search").alias("how"), F.lit(None).cast("string").alias("via")).unionByName(added)


# --- places within a file --------------------------------------------------------------

# Points of a class list for a name it has and for a part of one, at most; the
# shortest name of which a part counts; characters on either side of an anchor, an
# identifier, a class name and a data attribute; places of an identifier and of a class
# name that are shown, a class name in more places than the last is not; the gap that joins.
WHOLE_POINTS, PART_POINTS, PART_LEAST = 24, 12, 4
AROUND_ANCHOR, AROUND_ID, AROUND_CLASS, AROUND_DATA = 450, 260, 240, 280
ID_PLACES, CLASS_PLACES, CLASS_COMMON = 4, 5, 28
GAP = 8

_ID = re.compile(r"(?<![A-Za-z0-9_])id\s*=\s*[\"']([^\"']+)[\"']", re.I)
_CLASS = re.compile(r"(?<![A-Za-z0-9_])class\s*=\s*[\"']([^\"']+)[\"']", re.I)
_DATA = re.compile(r"(?<![A-Za-z0-9_])(data-[a-zA-Z0-9-]+)\s*=\s*[\"']([^\"']+)[\"']", re.I)
_VALUES = (re.compile(r"class\s*=\s*\"([^\"]*)\"", re.I), re.compile(r"class\s*=\s*'([^']*)'", re.I))
_ID_FORMS = ('id="{}"', "id='{}'", 'id={{"{}"}}', "id={{'{}'}}", "id={{`{}`}}")


def _names(snippet: str) -> list[str]:
    return sorted(dict.fromkeys(n for m in _CLASS.finditer(snippet) for n in m[1].split()), key=len, reverse=True)


def _likeness(value: str, wanted: list[str]) -> int:
    """Points of a class list for the names wanted: more for a name it has than for a part of one."""
    names = dict.fromkeys(value.lower().split())
    long = [n for n in names if len(n) >= PART_LEAST]

    def points(w: str) -> int:
        if w in names:
            return min(len(w) + 2, WHOLE_POINTS)
        shared = [min(len(n), len(w)) for n in long if len(w) >= PART_LEAST and (n in w or w in n)]
        return min(shared[0], PART_POINTS) if shared else 0

    return sum(map(points, wanted))


def class_anchor(content: str, snippet: str) -> int:
    """Where the class list most like the snippet's stands, -1 without any; the first of equals."""
    wanted = [n.lower() for n in _names(snippet) if len(n) >= 3]
    lists = [(m.start(), _likeness(m[1], wanted)) for pattern in _VALUES for m in pattern.finditer(content)] if wanted else []
    at, points = max(lists, key=lambda x: x[1], default=(-1, 0))
    return at if points else -1


def _ids(snippet: str) -> list[str]:
    return [i for m in _ID.finditer(snippet) if (i := m[1].strip())]


def anchors(content: str, snippet: str, needle: str = "") -> list[int]:
    """Distinct places of a file where a snippet may come from, the most telling first: its
    identifiers, data attributes, the class list most like its own, the needle that found
    the file, and its class names."""
    low = content.lower()
    places = [low.find(form.format(i).lower()) for i in _ids(snippet) for form in _ID_FORMS]
    places += [low.find(f"{m[1]}={q}{m[2].strip()}{q}".lower()) for m in _DATA.finditer(snippet) if m[2].strip() for q in "\"'"]
    places += [class_anchor(content, snippet), low.find(needle.lower()) if needle else -1]
    for name in _names(snippet):
        if len(name) >= 4:
            forms = (name, f'"{name}"', f"'{name}'") if len(name) >= 6 else (name,)
            places += [low.find(f.lower()) for f in forms]
    return [p for p in dict.fromkeys(places) if p >= 0]


def _occurrences(low: str, what: str) -> Iterator[int]:
    at = low.find(what)
    while at >= 0:
        yield at
        at = low.find(what, at + max(1, len(what)))


def grounding(content: str, snippet: str, anchor: int, budget: int = 12_000) -> str:
    """The stretches of a file around an anchor and around what the snippet names, those at most
    eight characters apart joined, each under a line that tells where it stands; stretches
    that would exceed the budget end the text."""
    low = content.lower()
    around = [(anchor, AROUND_ANCHOR)]
    for i in _ids(snippet):
        for form in _ID_FORMS[:4]:
            around += [(p, AROUND_ID) for _, p in zip(range(ID_PLACES), _occurrences(low, form.format(i).lower()))]
    for name in _names(snippet):
        places = list(_occurrences(low, name.lower())) if len(name) >= 5 else []
        around += [(p, AROUND_CLASS) for p in places[:CLASS_PLACES]] if len(places) <= CLASS_COMMON else []
    around += [(p, AROUND_DATA) for m in _DATA.finditer(snippet) if (p := low.find(f'{m[1]}="{m[2]}"'.lower())) >= 0]
    spans: list[list[int]] = []
    for begin, end in sorted((max(0, p - half), min(len(content), p + half)) for p, half in around):
        if spans and begin <= spans[-1][1] + GAP:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([begin, end])
    out = ""
    for begin, end in spans:
        piece = f"\n/* --- {begin} to {end} --- */\n{content[begin:end]}"
        if len(out) + len(piece) > budget:
            break
        out += piece
    return out.strip()


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _anchors(content: pd.Series, snippet: pd.Series, needle: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or s is None else anchors(c, s, n or "") for c, s, n in zip(content, snippet, needle)])


@F.pandas_udf(T.StringType())
def _grounding(content: pd.Series, snippet: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([None if c is None or s is None or p is None or not len(p) else grounding(c, s, int(p[0])) for c, s, p in zip(content, snippet, places)])


def patch_places(candidates: DataFrame, issues: DataFrame, files: DataFrame) -> DataFrame:
    """``issue_id, path, anchors, excerpt`` of the first candidate of each issue (``issue_id, path,
    digest, needle, rank``) in ``path, digest, content``; null without a place."""
    first_ = candidates.filter("rank = 1").select("issue_id", "path", "digest", "needle")
    rows = first_.join(issues.select("issue_id", "html_snippet"), "issue_id").join(files.select("path", "digest", "content"), ["path", "digest"])
    placed = rows.withColumn("anchors", _anchors("content", "html_snippet", "needle"))
    return placed.select("issue_id", "path", "anchors", _grounding("content", "html_snippet", "anchors").alias("excerpt"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _first_needles(snippet: pd.Series) -> pd.Series:
    return snippet.map(lambda s: None if s is None else search_needles(s)[:6])


def unlocated(issues: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """``issue_id, ord, needle, n_files``: for every issue without a candidate, its first six needles
    and the files that hold each. Needles of under three characters are in no index and count null."""
    missing = issues.filter("html_snippet is not null").join(candidates.select("issue_id").distinct(), "issue_id", "left_anti")
    asked = missing.select("issue_id", F.posexplode(_first_needles("html_snippet")).alias("ord", "needle")).withColumn("_n", F.lower("needle"))
    contents = files.groupBy("digest").agg(F.first("content").alias("content"), F.count_distinct("path").alias("_files"))
    held = files_with_needles(contents, asked.select(F.col("_n").alias("needle")).distinct(), 3).groupBy("needle").agg(F.sum("_files").alias("n"))
    counted = asked.join(held.withColumnRenamed("needle", "_n"), "_n", "left")
    return counted.select("issue_id", "ord", "needle", F.when(F.length("_n") >= 3, F.coalesce("n", F.lit(0))).alias("n_files"))
