"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm import copies, encodings, leakage, packing, residue, splitting, stuffing, terms, truncation
from sitegauge.sources import spread, table

_FIELDS = ["issue", "recommendation"]
_SAME = {"id_col": "issue_id", "plain": ["severity", "issue"], "markup": ["html_snippet"]}


def _pages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "pages").select("page_id", *columns))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "source", "text"))


def issue_records(spark: SparkSession, d: str) -> DataFrame:
    """The findings of both issue tables, unreadable payloads left out."""
    columns = ["issue_id", "severity", "issue", "html_snippet"]
    raw = copies.parse_payloads(table(spark, d, "raw_issues").select("issue_id", "payload"))
    return spread(table(spark, d, "model_issues").select(*columns)).unionByName(raw.select(*columns))


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(_pages(spark, d, "html"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_scores(spark, d).filter("stuffed").select("page_id")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.garbled(_pages(spark, d, "html"), "page_id", "html").withColumnRenamed("id", "page_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_restored(spark, d).select("page_id")


def p3_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_pages(spark, d, "host", "html", "fetch_error"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_residue(spark, d).select("page_id").distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    found = p3_residue(spark, d)
    return residue.clean_pages(table(spark, d, "pages"), found).select("page_id", "url")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(spread(table(spark, d, "model_issues").select(*_FIELDS)), _FIELDS).filter("mark is not null").select("field_name", "term", "mark")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(spread(table(spark, d, "model_issues").select(*_FIELDS)), _FIELDS)


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_values(table(spark, d, "model_issues"), _FIELDS)


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_pages(spark, d, "html"), table(spark, d, "budgets"), "page_id", "html").withColumnRenamed("id", "page_id")


def p5_reassembled(spark: SparkSession, d: str) -> DataFrame:
    """Every cut page put together again: its digest, and how many pieces break their budget."""
    pieces = p5_pieces(spark, d).join(table(spark, d, "budgets").select("budget_id", "capacity", F.coalesce("overlap", F.lit(0)).alias("overlap")), "budget_id")
    # a piece begins at a whole character, up to three bytes before the overlap
    extra = F.col("overlap_bytes") - F.when(F.col("piece_no") == 0, 0).otherwise(F.col("overlap"))
    own = F.decode(F.substring(F.encode("piece", "UTF-8"), F.col("overlap_bytes") + 1, F.octet_length("piece")), "UTF-8")
    whole = pieces.groupBy("budget_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("p"), F.count_if((F.octet_length("piece") > F.col("capacity")) | ~extra.between(0, 3)).alias("n_bad"))
    return whole.select("budget_id", "page_id", F.md5(F.array_join(F.transform("p", lambda x: x["own"]), "")).alias("digest"), "n_bad")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).filter("piece_no = 0").select("budget_id", "page_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.formatting_copies(issue_records(spark, d), **_SAME)


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed_records(issue_records(spark, d), **_SAME)


def p7_members(spark: SparkSession, d: str) -> DataFrame:
    """The tokenizer's file may be named in ``spark.sitegauge.tokenizer``."""
    tokenizer = spark.conf.get("spark.sitegauge.tokenizer", packing.TOKENIZER)
    return packing.pack_budgets(_documents(spark, d), table(spark, d, "budgets"), "doc_id", "text", tokenizer).withColumnRenamed("id", "doc_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(p7_members(spark, d), table(spark, d, "budgets"))


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    """Per budget the texts placed, those split although they fit, and the containers over capacity."""
    members = p7_members(spark, d)
    budgets = table(spark, d, "budgets").select("budget_id", "capacity")
    texts = members.groupBy("budget_id", "doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("size")).join(budgets, "budget_id")
    split = texts.groupBy("budget_id").agg(F.count("*").alias("n_texts"), F.count_if((F.col("n") > 1) & (F.col("size") <= F.col("capacity"))).alias("n_split_in_vain"))
    over = packing.containers(members, table(spark, d, "budgets")).groupBy("budget_id").agg(F.count_if(F.col("fill") > 1).alias("n_over"))
    return split.join(over, "budget_id")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(_documents(spark, d), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.cleaned_documents(_documents(spark, d), table(spark, d, "eval_items"))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The characters of every document as they were, from those kept and those removed."""
    kept = p8_clean(spark, d)
    return kept.select("doc_id", (F.length("text") + F.col("n_removed")).alias("n_chars"))


def p9_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts of every source that were judged."""
    return p9_sources(spark, d).select("source", "n_texts")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("coverage").alias("best_coverage"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation(_documents(spark, d)).filter("is_cut").select("doc_id")


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(truncation.truncation(_documents(spark, d)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_scores, p2_found, p2_restored, p3_found, p3_residue, p3_clean, p4_found, p4_terms, p4_values, p5_found, p5_pieces, p5_reassembled, p6_found, p6_records, p7_members, p7_containers, p7_valid, p8_found, p8_spans, p8_clean, p8_lengths, p8_items, p9_found, p9_sources, p9_texts)}

_TERMS = r"""
WITH tokens AS (
  SELECT 'issue' AS field_name, issue_id, lower(unnest(regexp_extract_all(issue, '[\p{L}\p{N}]+'))) AS term FROM model_issues
  UNION ALL
  SELECT 'recommendation', issue_id, lower(unnest(regexp_extract_all(recommendation, '[\p{L}\p{N}]+'))) FROM model_issues
), counted AS (
  SELECT field_name, term, count(*) AS n_occurrences, count(DISTINCT issue_id) AS n_records FROM tokens GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records > 0.2 * (SELECT count(*) FROM model_issues) THEN 'common' END AS mark FROM counted
)
"""



def _stripped(x: str) -> str:
    return f"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[\\p{{Z}}\\p{{C}}\\p{{P}}\\p{{S}}]+', '', 'g')"


_TAG_NAME = r"regexp_extract(s, '^<\s*/?\s*[^\s/>]*')"
_ATTRIBUTES = r"""regexp_extract_all(substr(s, length({name}) + 1), '[^\s="''/<>]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?')""".replace("{name}", _TAG_NAME)
_IN_ORDER = f"{_stripped(_TAG_NAME)} || array_to_string(list_sort(list_transform({_ATTRIBUTES}, lambda a: {_stripped('a')})), '')"
_COPIES = rf"""
WITH raw AS (
  SELECT issue_id, json_extract_string(payload, '$.severity') AS severity, json_extract_string(payload, '$.issue') AS issue, json_extract_string(payload, '$.htmlSnippet') AS html_snippet
  FROM raw_issues WHERE regexp_matches(payload, '^\s*\{{') AND json_valid(payload)
), records AS (
  SELECT issue_id, severity, issue, html_snippet FROM model_issues
  UNION ALL SELECT * FROM raw WHERE severity IS NOT NULL AND issue IS NOT NULL
), forms AS (
  SELECT issue_id, coalesce({_stripped('severity')}, chr(30)) AS a, coalesce({_stripped('issue')}, chr(30)) AS b,
    coalesce(CASE WHEN contains(html_snippet, '<') THEN array_to_string(list_transform(
      regexp_extract_all(html_snippet, '<(?:[^<>"'']|"[^"]*"|''[^'']*'')*>|<[^<>]*>?|[^<]+'),
      lambda s: CASE WHEN s[1] = '<' THEN {_IN_ORDER} ELSE {_stripped('s')} END), '') ELSE {_stripped('html_snippet')} END, chr(30)) AS c
  FROM records
), classes AS (SELECT issue_id, min(issue_id) OVER (PARTITION BY a, b, c) AS first_id FROM forms)
"""

SQL: dict[str, str] = {
    "p5_found": """
SELECT b.budget_id, p.page_id FROM pages p JOIN budgets b
  ON b.purpose = 'split' AND b.measure = 'utf8_bytes' AND octet_length(encode(p.html)) > b.capacity""",
    "p5_reassembled": """
SELECT b.budget_id, p.page_id, md5(p.html) AS digest, CAST(0 AS BIGINT) AS n_bad FROM pages p JOIN budgets b
  ON b.purpose = 'split' AND b.measure = 'utf8_bytes' AND octet_length(encode(p.html)) > b.capacity""",
    "p4_found": _TERMS + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_terms": _TERMS + "SELECT * FROM marked",
    "p4_values": """
SELECT *, n_occurrences AS n_records, CASE WHEN n_occurrences <= 2 THEN 'rare' WHEN n_occurrences > 0.2 * (SELECT count(*) FROM model_issues) THEN 'common' END AS mark FROM (
  SELECT field_name, value, count(*) AS n_occurrences FROM (
    SELECT 'issue' AS field_name, issue AS value FROM model_issues
    UNION ALL SELECT 'recommendation', recommendation FROM model_issues
  ) WHERE value IS NOT NULL GROUP BY ALL)""",
    "p6_found": _COPIES + "SELECT first_id, issue_id AS copy_id FROM classes WHERE issue_id <> first_id",
    "p6_records": _COPIES + "SELECT first_id, count(*) AS n_copies FROM classes GROUP BY first_id",
    "p8_lengths": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars FROM documents",
    "p9_texts": r"SELECT source, count(*) AS n_texts FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]') GROUP BY 1",
    "p7_valid": r"""
SELECT budget_id, n AS n_texts, CAST(0 AS BIGINT) AS n_split_in_vain, CAST(0 AS BIGINT) AS n_over
FROM budgets, (SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]'))
WHERE purpose = 'pack' AND measure = 'tokens'""",
}
