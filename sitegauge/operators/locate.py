"""From a finding to the source files it may come from."""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.functions.patterns import python
from sitegauge.functions.text import each, find_all
from sitegauge.session import cut_lineage

# Fixed values.
PATH_STOP_WORDS = ("en", "us", "in", "www", "html", "htm", "page", "index", "static", "assets", "api", "v1", "v2")
IMPORT_ENDINGS = (".js", ".jsx", ".ts", ".tsx", ".vue", ".mdx", ".html", ".htm")
IMPORTS = (
    r"(?-i)(?:^|[^\w$])(?:import|export)\s+(?:[^'\"`;]*?\s+from\s+)?[\"'`]([^\"'`]+)[\"'`]",
    r"(?-i)\brequire\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*\)",
    r"(?-i)\bimport\s*\(\s*[\"'`]([^\"'`]+)[\"'`]\s*\)",
)

# Searches for a snippet (fixed values).
_SPACE, _BETWEEN = python(r"\s+"), python(r">\s+<")
_HEAD_TEXTS = (
    (python(r"<title[^>]*>([^<]{8,500})<\/title>"), 200),
    (python(r"<meta[^>]*\bname\s*=\s*[\"']description[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']{12,800})[\"']"), 220),
    (python(r"<meta[^>]*\bproperty\s*=\s*[\"']og:description[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']{12,800})[\"']"), 220),
    (python(r"<meta[^>]*\bproperty\s*=\s*[\"']og:title[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']{8,400})[\"']"), 160),
    (python(r"<meta[^>]*\bproperty\s*=\s*[\"']twitter:title[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']{8,400})[\"']"), 160),
)
_DOCUMENT_TAG, _META = python(r"<\s*(html|head|body|main|title|h1|h2|h3)\b[^>]*"), python(r"<meta\b[^>]{10,500}>")
_ID, _CLASS = python(r"\bid\s*=\s*[\"']([^\"']+)[\"']"), python(r"\bclass\s*=\s*[\"']([^\"']+)[\"']")
_CLASS_NAME = python(r"\bclassName\s*=\s*(?:[\"']([^\"']+)[\"']|\{[\"']([^\"']+)[\"']\})")
_DATA, _HREF = python(r"\bdata-[a-zA-Z0-9-]+\s*=\s*[\"']([^\"']+)[\"']"), python(r"\bhref\s*=\s*[\"']([^\"']+)[\"']")
_HELPERS = (python(r"\bcn\s*\(\s*[\"']([^\"']{4,})[\"']"), python(r"\bcn\s*\(\s*`([^`]{4,})`"))
_OPENING = python(r"(?-i)<\s*[a-zA-Z0-9_.-]+\b[^>]{0,400}")
_UNSEEN = (python(r"<script[\s\S]*?<\/script>"), python(r"<style[\s\S]*?<\/style>"), python(r"<[^>]+>"), python("&nbsp;"))
_ID_FORMS = ('id="%s"', "id='%s'", 'id={"%s"}', "id={'%s'}", "id={`%s`}")
_ID_USES = ('htmlFor="%s"', "htmlFor='%s'", 'htmlFor={"%s"}', 'aria-labelledby="%s"', 'aria-controls="%s"')
_CLASS_FORMS = ('className="%s"', "className='%s'", 'className={"%s"}', "className={'%s'}", "className={`%s`}")
#: No needle is shorter than a gram; the bits are a filter that only ever lets too much through.
GRAM, GRAM_BITS = 3, 1 << 20


def _long_first(tokens: list[str]) -> list[str]:
    return sorted(dict.fromkeys(tokens), key=len, reverse=True)


def repo_target(url: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The target of the first pattern that the address matches, else ``default``."""
    out = F.lit(default)
    for pattern, target in reversed(rules):
        out = F.when(F.lower(F.coalesce(url, F.lit(""))).rlike(pattern), target).otherwise(out)
    return out


def path_tokens(url: Column) -> Column:
    """Distinct telling path segments of an address, each also without its dashes."""
    path = F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.try_parse_url(url, F.lit("PATH")))
    parts = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), "/"), F.lower), lambda p: (F.length(p) > 2) & ~p.isin(*PATH_STOP_WORDS))
    plain = F.transform(parts, lambda p: F.regexp_replace(p, "[-_]+", ""))
    both = F.flatten(F.zip_with(parts, plain, lambda p, q: F.when((q != p) & (F.length(q) > 3), F.array(p, q)).otherwise(F.array(p))))
    return F.array_distinct(both)


def path_segments(path: Column) -> Column:
    parts = F.split(F.lower(path), r"[/\\.\-_]+")
    return F.filter(parts, lambda s: F.length(s) >= 3)


def path_boost(path: Column, tokens: Column) -> Column:
    """Two points for each token within the path, one for each segment related to a token."""
    low, segments = F.lower(path), F.filter(path_segments(path), lambda s: F.length(s) >= 4)
    one = lambda t: F.when((F.length(t) > 2) & F.contains(low, t), 2).otherwise(0) + F.size(F.filter(segments, lambda s: F.contains(s, t) | F.contains(t, s)))
    return F.aggregate(F.transform(tokens, one), F.lit(0), lambda a, b: a + b)


def snippet_words(snippet: Column) -> Column:
    """Distinct words of five letters and digits or more of a snippet's text."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(snippet, "<[^>]*>", " "), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 5))


def files_with_needles(files: DataFrame, needles: DataFrame, gram: int = 4) -> DataFrame:
    """The columns of ``files`` but ``content``, and those of ``needles``, where the file contains ``needle``, case aside.

    A needle's first ``gram`` characters are an equi-join key against the distinct grams of
    each file, so that no file meets a needle it shares nothing with; the full test follows.
    The columns beside ``content`` tell the files apart. Null contents hold nothing.
    """
    keys = [c for c in files.columns if c != "content"]
    low = files.filter("content is not null").select(*keys, F.lower("content").alias("_c"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_c") - gram + 1, F.lit(1))), lambda k: F.substring(F.col("_c"), k, gram)))
    keyed = each(low, grams, "_g", *keys)
    wanted = needles.withColumn("_n", F.lower("needle")).filter(F.length("_n") >= gram).withColumn("_g", F.substring("_n", 1, gram))
    given = [*needles.columns, "_n"]
    # the text meets the needles that share a gram with it at once, not each on its own
    met = keyed.join(wanted, "_g").groupBy(*keys, F.pmod(F.xxhash64("_n"), F.lit(16)).alias("_part")).agg(F.collect_list(F.struct(*given)).alias("_a"))
    both = met.join(low, keys).withColumn("_hit", F.filter("_a", lambda a: F.contains(F.col("_c"), a["_n"])))
    return both.select(*keys, F.explode("_hit").alias("_h")).select(*keys, *[F.col(f"_h.{c}").alias(c) for c in needles.columns])


def distinct_files(resources: DataFrame) -> DataFrame:
    """``path, digest, content``: one file per address and content, so that only exact copies collapse."""
    return resources.filter("content is not null").groupBy(F.col("url").alias("path"), F.md5(F.encode("content", "UTF-8")).alias("digest")).agg(F.first("content").alias("content"))


def search_needles(snippet: str) -> list[str]:
    """What may stand in a source file of the snippet, the most telling first, case kept."""
    raw, out = snippet.strip(), {}
    if not raw:
        return []

    def push(s: str, least: int = 1) -> None:
        s = s.strip()
        if len(s) >= least:
            out.setdefault(s)

    for pattern, most in _HEAD_TEXTS:
        if m := pattern.search(raw):
            push(m[1].strip()[:most], 8)
    for m in _DOCUMENT_TAG.finditer(raw):
        tag = _SPACE.sub(" ", m[0]).strip()
        push(tag, 4)
        push(tag[:80], 4)
    push("<!doctype html")
    push("<!DOCTYPE html")
    for m in _META.finditer(raw):
        tag = _SPACE.sub(" ", m[0]).strip()
        if len(tag) >= 14:
            push(tag[:120], 4)
    for m in _ID.finditer(raw):
        if v := m[1].strip():
            for form in (*_ID_FORMS, *_ID_USES):
                push(form % v)
            push(v, 3)
    for m in _CLASS.finditer(raw):
        push(m[0], 7)
        v = m[1].strip()
        if len(v) >= 5:
            for form in _CLASS_FORMS:
                push(form % v)
            for t in _long_first(v.split()):
                if len(t) >= 4:
                    for form in ("%s", '"%s"', "'%s'"):
                        push(form % t)
    for m in _CLASS_NAME.finditer(raw):
        for t in _long_first((m[1] or m[2]).split()):
            push(t, 4)
    for m in _DATA.finditer(raw):
        push(m[0], 8)
        push(m[1], 4)
    for m in _HREF.finditer(raw):
        push(m[1], 8)
    for pattern in _HELPERS:
        for m in pattern.finditer(raw):
            push(m[1], 4)
    if m := _OPENING.search(raw):
        tag = _SPACE.sub(" ", m[0]).strip()
        push(tag, 10)
        if len(tag) >= 24:
            push(tag[:90], 20)
    if raw.startswith("<") and len(raw) <= 800:
        push(raw, 4)
    push(raw, 8)
    push(_SPACE.sub(" ", raw), 8)
    push(_SPACE.sub(" ", _BETWEEN.sub("><", raw)), 8)
    push(_SPACE.sub("", raw), 12)
    seen = raw
    for pattern in _UNSEEN:
        seen = pattern.sub(" ", seen)
    seen = _SPACE.sub(" ", seen).strip()
    for t in seen.split():
        push(t, 12)
    for n in range(min(140, len(seen)), 17, -12):
        push(seen[:n], 18)
    return list(out)


def search_steps(snippet: str, words: list[str]) -> list[tuple[int, str, list[str], list[str]]]:
    """``tier, needle, also, narrow`` of the searches for a snippet, in order.

    Identifiers (tier 1, narrowed by the classes), the two longest classes together (2), one class
    (3), the other needles (4), and last ``words`` (5), which are too short for tier 4. A file has to
    contain ``needle`` and all of ``also``; of such files, those with the first of ``narrow`` go before
    those without, and so on.
    """
    classes = [t for t in _long_first([t for m in _CLASS.finditer(snippet) for t in m[1].split()]) if len(t) >= 4]
    ids = [v for m in _ID.finditer(snippet) if (v := m[1].strip())]
    out = [(1, form % v, [], classes) for v in ids for form in _ID_FORMS]
    out += [(2, classes[0], classes[1:2], [])] if len(classes) > 1 else []
    out += [(3, t, [], []) for t in classes]
    out += [(4, n, [], []) for n in search_needles(snippet)]
    return out + [(5, w, [], []) for w in words]


def _hashes(text: str) -> set[int]:
    """Of the grams of a lower-case text."""
    return {zlib.crc32(g.encode("utf-8", "replace")) % GRAM_BITS for g in {text[k : k + GRAM] for k in range(len(text) - GRAM + 1)}}


def gram_bits(contents: DataFrame) -> bytes:
    """A bit for every hash of a gram that occurs in any content: at most ``GRAM_BITS`` of them, whatever the files."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def hashes(content: pd.Series) -> pd.Series:
        return pd.Series([list(_hashes(c.lower())) for c in content], dtype=object)

    bits = bytearray(GRAM_BITS // 8)
    h = contents.select(F.explode(hashes("content")).alias("h"))
    for r in h.groupBy((F.col("h") / 32).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, h % 32)")).alias("set")).collect():
        bits[4 * r["at"] : 4 * r["at"] + 4] = r["set"].to_bytes(4, "little")
    return bytes(bits)


def steps_of_issues(issues: DataFrame, bits: bytes) -> DataFrame:
    """``issue_id, page_id, step`` and the columns of ``search_steps``, without the needles that have a gram no file has."""

    def run(batches):  # noqa: ANN001, ANN202
        known: dict[str, bool] = {}

        def has(gram: str) -> bool:
            if (found := known.get(gram)) is None:
                if len(known) > 500_000:
                    known.clear()
                h = zlib.crc32(gram.encode("utf-8", "replace")) % GRAM_BITS
                found = known[gram] = bool(bits[h >> 3] >> (h & 7) & 1)
            return found

        def may(needle: str) -> bool:
            low = needle.lower()
            return all(has(low[k : k + GRAM]) for k in range(len(low) - GRAM + 1))

        for batch in batches:
            rows = []
            for issue, page, snippet, words in zip(*[c.to_pylist() for c in batch.columns]):
                for k, (tier, needle, also, narrow) in enumerate(search_steps(snippet, words)):
                    if may(needle) and all(map(may, also)):
                        rows.append((issue, page, k, tier, needle, also or None, narrow or None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    names = ["issue_id", "page_id", "step", "tier", "needle", "also", "narrow"]
    rows = issues.filter("html_snippet is not null").select("issue_id", "page_id", "html_snippet", snippet_words(F.col("html_snippet")).alias("words"))
    return rows.mapInArrow(run, "issue_id bigint, page_id bigint, step int, tier int, needle string, also array<string>, narrow array<string>")


def page_boosts(pages: DataFrame, roots: DataFrame) -> DataFrame:
    """``page_id, root, boost`` where the address of a page points at ``root``, a path within its site.

    A token is related to a path only if the path contains it or it contains a segment of the
    path, and both leave grams in common, so related pairs are found by equi-joins.
    """
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda k: F.substring(c, k, n)))
    of_page = each(pages, path_tokens(F.col("url")), "token", "page_id").distinct()
    tokens = of_page.select("token").distinct()
    within = each(roots, grams(F.lower("root"), 3), "g", "root").join(tokens.withColumn("g", F.substring("token", 1, 3)), "g").filter(F.contains(F.lower("root"), F.col("token")))
    segments = each(roots, F.array_distinct(F.filter(path_segments(F.col("root")), lambda s: F.length(s) >= 4)), "s", "root")
    around = each(tokens, grams(F.col("token"), 4), "g", "token").join(segments.select("s").distinct().withColumn("g", F.substring("s", 1, 4)), "g").filter(F.contains("token", F.col("s"))).select("token", "s").join(segments, "s")
    pairs = within.select("token", "root").union(around.select("token", "root")).distinct()
    points = pairs.withColumn("boost", path_boost(F.col("root"), F.array("token")))
    return of_page.join(points, "token").groupBy("page_id", "root").agg(F.sum("boost").cast("int").alias("boost"))


def candidate_files(issues: DataFrame, pages: DataFrame, files: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` files of the searches for each issue's snippet, with the search that found them.

    A search with one file gives it. One with several gives the file the page's address points at
    most, or if several are level the first ``most`` it points at, or none. The boost depends on the
    path within the site, so of each such path only the first ``most`` files can be among them.
    """
    root = F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/*", ""), r"[?#].*$", "")
    known = files.select("path", "digest", root.alias("root"))
    contents = files.groupBy("digest").agg(F.first("content").alias("content"))
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    key = F.concat_ws("\x01", F.lower("needle"), F.when(F.col("also").isNotNull() | F.col("narrow").isNotNull(), F.concat_ws("\x02", F.concat_ws("\x01", low(F.col("also"))), F.concat_ws("\x01", low(F.col("narrow"))))))
    steps = cut_lineage(steps_of_issues(issues, gram_bits(contents)).withColumn("key", key))
    found = files_with_needles(contents, steps.select(F.lower("needle").alias("needle")).distinct(), GRAM).join(known, "digest")
    narrowed = steps.filter("also is not null or narrow is not null").select("key", F.lower("needle").alias("needle"), low(F.col("also")).alias("also"), low(F.col("narrow")).alias("narrow")).dropDuplicates(["key"])
    tested = narrowed.join(found, "needle").join(contents.select("digest", F.lower("content").alias("c")), "digest").filter(F.forall("also", lambda t: F.contains("c", t)))
    tested = tested.select("key", "path", "digest", "root", F.array_join(F.transform("narrow", lambda t: F.contains(F.col("c"), t).cast("int").cast("string")), "").alias("v"))
    tested = tested.withColumn("best", F.max("v").over(Window.partitionBy("key"))).filter("v = best").drop("v", "best")
    plain = steps.filter("also is null and narrow is null").select("key").distinct().join(found.withColumnRenamed("needle", "key"), "key")
    of_root = Window.partitionBy("key", "root")
    hits = plain.select("key", "path", "digest", "root").unionByName(tested).withColumn("n", F.count("*").over(of_root)).withColumn("at", F.row_number().over(of_root.orderBy("path", "digest"))).filter(F.col("at") <= most)
    hits = hits.groupBy("key", "root", "n").agg(F.collect_list(F.struct("path", "digest")).alias("files")).withColumn("total", F.sum("n").over(Window.partitionBy("key")))

    rows = steps.select("issue_id", "page_id", "step", "tier", "needle", "key").join(hits, "key").join(page_boosts(pages, known.select("root").distinct()), ["page_id", "root"], "left").withColumn("boost", F.coalesce("boost", F.lit(0))).filter("total = 1 or boost > 0")
    of_step, of_issue = Window.partitionBy("issue_id", "step"), Window.partitionBy("issue_id")
    rows = rows.select("issue_id", "step", "tier", "needle", "n", "files", "boost").repartition("issue_id").withColumn("top", F.max("boost").over(of_step)).withColumn("winners", F.sum(F.when(F.col("boost") == F.col("top"), F.col("n"))).over(of_step))
    single = rows.filter("winners > 1 or boost = top").select("issue_id", "step", "tier", "needle", "boost", F.inline("files"))
    single = single.withColumn("at", F.row_number().over(of_step.orderBy(F.desc("boost"), "path", "digest"))).filter(F.col("at") <= most)
    first = single.groupBy("issue_id", "path", "digest").agg(F.min(F.struct("step", "at", "tier", "needle", "boost")).alias("s"))
    ranked = first.withColumn("rank", F.row_number().over(of_issue.orderBy("s.step", "s.at"))).filter(F.col("rank") <= most)
    return ranked.select("issue_id", "path", "digest", "s.tier", "s.needle", "s.boost", "rank")


def import_edges(files: DataFrame) -> DataFrame:
    """``src, dst`` of local imports, resolved to an existing file: as named, with an ending, or an index."""
    specs = each(files, F.array_distinct(F.flatten(F.array(*[find_all(F.col("content"), p, 1) for p in IMPORTS]))), "spec", F.col("path").alias("src"))
    local = specs.filter(F.col("spec").startswith(".") | F.col("spec").startswith("/"))
    folder = F.regexp_extract("src", "^(.*)/[^/]*$", 1)
    raw = F.when(F.col("spec").startswith("/"), F.col("spec")).otherwise(F.concat(folder, F.lit("/"), F.col("spec")))
    parts = F.filter(F.split(raw, "/"), lambda p: (p != "") & (p != "."))
    # a leading step back has nothing to remove and points outside the root
    step = lambda s, p: F.when(p == "..", F.when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array(F.lit("..")))).otherwise(F.concat(s, F.array(p)))
    base = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    endings = ("", *IMPORT_ENDINGS, *[f"/index{e}" for e in IMPORT_ENDINGS])
    tried = local.select("src", "spec", F.posexplode(F.array(*[F.concat(base, F.lit(e)) for e in endings])).alias("try", "dst"))
    known = files.select(F.regexp_replace("path", "^/+", "").alias("dst")).distinct()
    found = tried.join(known, "dst").groupBy("src", "spec").agg(F.min_by("dst", "try").alias("dst"))
    return found.select(F.regexp_replace("src", "^/+", "").alias("src"), "dst").distinct()


def reachable(edges: DataFrame, depth: int = 2) -> DataFrame:
    """``src, dst, depth``: files reached over at most ``depth`` imports, by the shortest way."""
    level = edges.select("src", "dst", F.lit(1).alias("depth"))
    out = level
    for k in range(2, depth + 1):
        level = level.alias("a").join(edges.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"), F.lit(k).alias("depth"))
        out = out.unionByName(level)
    return out.filter("src <> dst").groupBy("src", "dst").agg(F.min("depth").alias("depth"))


def merge_ranges(rows: DataFrame, key: str, gap: int = 8) -> DataFrame:
    """``key, begin, end`` of the runs of ranges that overlap or lie at most ``gap`` apart."""
    order = Window.partitionBy(key).orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("begin") > before + gap), 1).otherwise(0)
    runs = rows.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(key, "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_run")


def is_skipped(path: Column, skips: list[str]) -> Column:
    """Whether a path is one of the skipped names, ends in one, or lies at one; case aside."""
    low = F.lower(path)
    out = F.lit(False)
    for s in skips:
        if s:
            out = out | (low == s.lower()) | low.endswith("/" + s.lower())
    return out


def excerpt(content: str, needles: list[str], before: int = 180, after: int = 380, budget: int = 4000) -> str:
    """The surroundings of every needle, those that touch joined, up to a budget of characters."""
    low, spans = content.lower(), []
    for n in needles:
        at = low.find(n.lower()) if n else -1
        while at >= 0:
            spans.append((max(0, at - before), min(len(content), at + after)))
            at = low.find(n.lower(), at + 1)
    out, end, room = [], -1, budget
    for a, b in sorted(spans):
        a = max(a, end)
        if b > a and room > 0:
            piece = content[a : min(b, a + room)]
            out.append(piece if a == end else ("\n…\n" if out else "") + piece)
            room -= len(piece)
            end = b
    return "".join(out)


@F.pandas_udf(T.StringType())
def excerpts(content: pd.Series, needles: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else excerpt(c, list(n) if n is not None else []) for c, n in zip(content, needles)])
