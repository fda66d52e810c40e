"""Records that differ only in formatting, collapsed to one each (problem 6).

Progressive partition refinement. Every record first gets a cheap invariant: the
length of its stripped text and a letter histogram, both blind to the order of
attributes. Only records whose invariant is shared go on to the costly key, the
normal form with sorted attributes, and are grouped by its 128-bit digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.skew import join_classes
from sitegauge.session import cut_lineage

#: White space, control and format characters, punctuation and symbols.
_NOISE = r"[\p{Z}\p{C}\p{P}\p{S}]+"
_SEGMENT = r"<(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[^<>]*+>?|[^<]++"
_ATTRIBUTE = r"[^\s=\"'/<>]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?"
#: Letters and digits whose counts make up the histogram.
HISTOGRAM = "etaoinsrhldc0123456789"


def strip_noise(c: Column) -> Column:
    """Letters, marks and digits of ``c`` in one letter case."""
    # the capital form of this letter is two others
    return F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), _NOISE, "")


def normal_markup(c: Column) -> Column:
    """``strip_noise`` of markup, the attributes of each tag in sorted order first.

    A tag whose quotes do not close ends at its first ``>``; text after an
    unclosed ``<`` is read as one tag. Text without a tag is just stripped.
    """
    def tag(segment: Column) -> Column:
        name = F.regexp_extract(segment, r"^<\s*/?\s*[^\s/>]*", 0)
        attributes = F.regexp_extract_all(F.substr(segment, F.length(name) + 1), F.lit(_ATTRIBUTE), F.lit(0))
        return F.concat(strip_noise(name), F.array_join(F.array_sort(F.transform(attributes, strip_noise)), ""))

    segments = F.regexp_extract_all(c, F.lit(_SEGMENT), F.lit(0))
    ordered = F.array_join(F.transform(segments, lambda s: F.when(s.startswith("<"), tag(s)).otherwise(strip_noise(s))), "")
    return F.when(c.contains("<"), ordered).otherwise(strip_noise(c))


def parse_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``severity, issue, recommendation, html_snippet`` read from a JSON object.

    Payloads that are no object, do not parse to their end, or lack severity or
    issue are dropped. An absent snippet and a null one are both null.
    """
    schema = "severity string, issue string, recommendation string, htmlSnippet string, _bad string"
    parsed = F.from_json(F.col(payload), schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = df.filter(F.col(payload).rlike(r"^\s*\{")).withColumn("_p", parsed)
    rows = rows.filter("_p is not null and _p._bad is null and _p.severity is not null and _p.issue is not null")
    return rows.withColumns({"severity": F.col("_p.severity"), "issue": F.col("_p.issue"), "recommendation": F.col("_p.recommendation"), "html_snippet": F.col("_p.htmlSnippet")}).drop("_p")


def _keyed(df: DataFrame, id_col: str, plain: list[str], markup: list[str]) -> DataFrame:
    """``id, key`` of the records that share their cheap invariant with another."""
    wanted = [*plain, *markup]
    given = df.select(F.col(id_col).alias("_id"), *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(wanted)])
    cells = [F.col(f"_{i}") for i in range(len(wanted))]
    rows = given.withColumn("_s", strip_noise(F.concat_ws("", *cells)))
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    counts = [F.length(F.col("_s")) - F.length(F.replace(F.col("_s"), F.lit(x), F.lit(""))) for x in HISTOGRAM]
    rows = rows.withColumn("_cheap", F.xxhash64(nulls, F.length("_s"), *counts)).drop("_s")
    # only ids and invariants travel to find the shared ones; the texts move once, by their ids
    cheap = cut_lineage(rows.filter("_id is not null").select("_id", "_cheap"))
    shared = cheap.groupBy("_cheap").agg(F.count("*").alias("_n")).filter("_n > 1")
    wanted = join_classes(cheap, shared, "_cheap", F.col("_n"), "_id").select("_id")
    rows = given.join(wanted, "_id", "left_semi")
    forms = [normal_markup(c) if i >= len(plain) else strip_noise(c) for i, c in enumerate(cells)]
    # concat_ws skips nulls, so a missing cell gets a letterless mark that no normal form holds
    form = F.concat_ws("\x1f", *[F.coalesce(f, F.lit("\x1e")) for f in forms])
    return rows.select("_id", F.unhex(F.md5(form)).alias("_key"))


def formatting_copies(df: DataFrame, id_col: str, plain: list[str], markup: list[str], salts: int = 16) -> DataFrame:
    """``first_id, copy_id``: one row for each record that is not the smallest id of its class.

    Records are equal if every ``plain`` and ``markup`` cell agrees apart from
    white space, letter case, punctuation, symbols and attribute order; a null
    equals only a null, and an empty cell is not a null. Rows that repeat an id
    count as one record, rows without an id as none. A class of any size is handled: counts are aggregated
    before the shuffle and the join back is salted on the side of the records.
    """
    keyed = cut_lineage(_keyed(df, id_col, plain, markup))
    classes = keyed.groupBy("_key").agg(F.min("_id").alias("first_id"), F.max("_id").alias("_last"), F.count("*").alias("_n")).filter("first_id <> _last")
    found = join_classes(keyed, classes.select("_key", "first_id", "_n"), "_key", F.col("_n"), "_id", salts).select("first_id", F.col("_id").alias("copy_id"))
    return found.filter("copy_id <> first_id").distinct()


def collapsed_records(df: DataFrame, id_col: str, plain: list[str], markup: list[str]) -> DataFrame:
    """``first_id, n_copies`` of every class, single records included (``n_copies`` 1)."""
    copies = formatting_copies(df, id_col, plain, markup)
    counts = copies.groupBy(F.col("first_id").alias("_f")).agg((F.count("*") + 1).alias("_n"))
    firsts = df.select(F.col(id_col).alias("first_id")).distinct().join(copies.select(F.col("copy_id").alias("first_id")), "first_id", "left_anti")
    return firsts.join(counts, F.col("first_id") == F.col("_f"), "left").select("first_id", F.coalesce("_n", F.lit(1).cast("bigint")).alias("n_copies"))
