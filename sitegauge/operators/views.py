"""Report views: grouping, progress, labels, intake checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.functions.text import half_up, trim_all, units

FEWEST_UNITS, MOST_UNITS = 100, 10 * 1024 * 1024


def grouped_issues(issues: DataFrame) -> DataFrame:
    """``page_id, severity, issue, recommendation, n_issues, n_snippets`` per distinct finding of a page.

    Texts are compared trimmed; a null recommendation groups with an empty one.
    """
    text = trim_all(F.col("issue"))
    advice = trim_all(F.coalesce("recommendation", F.lit("")))
    snippet = F.nullif(trim_all(F.coalesce("html_snippet", F.lit(""))), F.lit(""))
    return issues.groupBy("page_id", "severity", text.alias("issue"), advice.alias("recommendation")).agg(F.count("*").alias("n_issues"), F.countDistinct(snippet).alias("n_snippets"))


def grouped_snippets(issues: DataFrame, order: list[str]) -> DataFrame:
    """``page_id, severity, issue, recommendation, first_seen, snippets`` per distinct finding of a page:
    its distinct snippets, trimmed and not empty, in the order first seen; ``first_seen`` has the
    ``order`` columns of its first row, by which the findings of a page are listed."""
    text = trim_all(F.col("issue"))
    advice = trim_all(F.coalesce("recommendation", F.lit("")))
    snippet = F.nullif(trim_all(F.coalesce("html_snippet", F.lit(""))), F.lit(""))
    rows = issues.select("page_id", "severity", text.alias("issue"), advice.alias("recommendation"), snippet.alias("snippet"), F.struct(*order).alias("at"))
    key = ["page_id", "severity", "issue", "recommendation"]
    once = rows.groupBy(*key, "snippet").agg(F.min("at").alias("at"))
    seen = F.array_sort(F.collect_list(F.when(F.col("snippet").isNotNull(), F.struct("at", "snippet"))))
    return once.groupBy(*key).agg(F.min("at").alias("first_seen"), F.transform(seen, lambda x: x["snippet"]).alias("snippets"))


def first_per_url(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The first row of every ``url`` in an order; rows without an address stay."""
    place = F.row_number().over(Window.partitionBy("url").orderBy(*order))
    return rows.withColumn("_at", place).filter("_at = 1 or url is null").drop("_at")


def kilobytes(size: Column) -> Column:
    return half_up(size / F.lit(1000.0), 1)


def file_label(url: Column) -> Column:
    """The last part of an address without its query, or the address where that is empty."""
    last = F.element_at(F.split(F.element_at(F.split(url, r"\?"), 1), "/"), -1)
    return F.when(last == "", url).otherwise(last)


def file_slug(url: Column, most: int = 40) -> Column:
    """A file name for a page's report: its address without the protocol, other signs as low lines."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "^(.*?)(?i:https?://)", "$1")
    return F.substring(F.regexp_replace(bare, "[^A-Za-z0-9_.-]", "_"), 1, most)


def live_jobs(items: DataFrame, now: Column, keep_ms: int = 30 * 60 * 1000) -> DataFrame:
    """``job_id, last_update`` of the jobs that were updated within the time jobs are kept."""
    last = items.groupBy("job_id").agg(F.max("updated_at").alias("last_update"))
    return last.filter(now - F.col("last_update") <= keep_ms)


def ratio_band(ratio: Column) -> Column:
    return F.when(ratio > 30, "very_high").when(ratio > 15, "high").when(ratio > 5, "fair").otherwise("good")


def segment_band(ratio: Column) -> Column:
    return F.when(ratio > 30, "very_high").when(ratio > 15, "high").otherwise("fair")


def unused_band(pct: Column) -> Column:
    return F.when(pct >= 90, "severe").when(pct >= 70, "high").otherwise("moderate")


def latest_items(items: DataFrame) -> DataFrame:
    """The last state of each item of a job: deliveries repeat and earlier states arrive too."""
    last = items.groupBy("job_id", "item_no").agg(F.max(F.struct("updated_at", "item_status", "error", "url", "page_id")).alias("s"))
    return last.select("job_id", "item_no", "s.*")


def job_progress(items: DataFrame) -> DataFrame:
    """``job_id, n_items, n_done, n_failed, pct`` of the latest states."""
    last = latest_items(items)
    per = last.groupBy("job_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("item_status") == "done").alias("n_done"), F.count_if(F.col("item_status") == "failed").alias("n_failed"))
    return per.withColumn("pct", half_up((F.col("n_done") + F.col("n_failed")) / F.col("n_items") * 100).cast("int"))


def host_label(url: Column) -> Column:
    """The host of an address, or what was given where it has none."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), url)


def urls_of_lines(lines: DataFrame, line: str, order: list[str]) -> DataFrame:
    """``ord, url``: every cell of comma-separated lines that is an http address, once, in order.

    Cells are trimmed and lose one quote on either side; quoting does not protect commas.
    """
    cells = lines.select(*order, F.posexplode(F.split(line, ",")).alias("_p", "_c"))
    url = F.regexp_replace(trim_all(F.col("_c")), "^[\"']|[\"']$", "")
    valid = cells.withColumn("url", url).filter(F.col("url").rlike(r"^https?://[^\s/?#]+") & ~F.col("url").rlike(r"^https?://[^/?#]*[\s<>]"))
    first = valid.groupBy("url").agg(F.min(F.struct(*order, "_p")).alias("_o"))
    return first.select("_o.*", "url")


def fetch_verdicts(pages: DataFrame) -> DataFrame:
    """``page_id, verdict``: whether what was fetched can be audited, judged by the html itself and, where
    the table has them, by ``status`` and ``content_type``."""
    size = units(F.col("html"))
    status = (F.col("status").cast("int").between(200, 299)) if "status" in pages.columns else F.lit(True)
    kind = F.lower("content_type").startswith("text/html") if "content_type" in pages.columns else F.lit(True)
    verdict = F.when(~F.coalesce(F.col("url").rlike("(?i)^https?://"), F.lit(False)), "bad_address").when(~F.coalesce(status, F.lit(False)), "bad_status").when(~F.coalesce(kind, F.lit(False)), "not_html").when(F.col("html").isNull(), "no_html").when(size < FEWEST_UNITS, "too_small").when(size > MOST_UNITS, "too_large").otherwise("ok")
    return pages.select("page_id", verdict.alias("verdict"))


def feedback_listing(notes: DataFrame) -> DataFrame:
    """Notes with an id and a message, newest first by their time as text; times that are no
    ISO time come as null and last."""
    at = F.try_to_timestamp("created_at")
    return notes.filter("feedback_id is not null and message is not null").select("feedback_id", "message", at.alias("created_at")).orderBy(F.desc_nulls_last("created_at"), "feedback_id")


def site_rollup(scores: DataFrame, pages: DataFrame) -> DataFrame:
    """``host, criterion, n_pages, mean_score``, with host totals and a grand total as nulls."""
    joined = scores.join(pages.select("page_id", "host"), "page_id")
    return joined.rollup("host", "criterion").agg(F.count("*").alias("n_pages"), half_up(F.avg("score"), 2).alias("mean_score"))


def enriched_metrics(metrics: DataFrame, totals: DataFrame) -> DataFrame:
    """Text metrics with what the page's scripts and style sheets weigh against its text; pages
    without captured resources keep zeros. The inline styles of ``css_chars``, where the
    metrics have them, count with the sheets."""
    wide = totals.groupBy("page_id").pivot("kind", ["js", "css"]).agg(F.first("chars").alias("chars"), F.first("app_chars").alias("app_chars"), F.first("n_files").alias("n_files"))
    names = [c for c in wide.columns if c != "page_id"]
    joined = metrics.join(wide, "page_id", "left").fillna(0, names)
    text = F.greatest(F.col("visible_chars"), F.lit(1))
    styles = F.col("css_chars") + F.col("inline_css_chars") if "inline_css_chars" in metrics.columns else F.col("css_chars")
    return joined.withColumns({"js_to_text": half_up(F.col("js_chars") / text, 2), "js_app_to_text": half_up(F.col("js_app_chars") / text, 2), "css_to_text": half_up(styles / text, 2)})
