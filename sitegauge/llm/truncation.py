"""Text cut off by field limits (problem 9).

Signs that a rest was dropped and open markup speak for themselves, and a text that ends
in a closed sentence, tag, code block or score is whole. Every other text stops in a line
or sentence that may be unfinished. That closing unit, numbers and addresses masked, is
looked up by the strict-prefix self-join: a longer copy elsewhere shows that it was cut,
a line of its own elsewhere that it is whole. What neither settles is decided by the exact
lengths at which its source cuts, and at last by the form of the line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.prefixes import values_with_longer
from sitegauge.llm.skew import attach_classes
from sitegauge.session import cut_lineage

WHOLE, CUT, OPEN = 0, 1, 2

_SIGN = re.compile(
    r"(?:[\[(][^\[\]()\n]{0,60}?(?:truncat|clipp|omitted|more (?:char|word|byte|line)|left out|shortened|snip|cut off|gekürzt|tronqu|trunc|recort)[^\[\]()\n]{0,40}[\])]"
    r"|\[(?:…|\.\.\.)\]|<!--(?:[^>\n]{0,80})(?:left out|truncat|omitted|clipp|cut|more)[^>\n]{0,80}-->"
    r"|(?:…|\.\.\.)\s*\(?(?:read|show|see|view) (?:more|full|all)[^\n]{0,30}|…|\.\.\.)\s*$",
    re.I,
)
_SENTENCE_END = re.compile(r"[.!?。！？؟।][\"'”’»)\]*_`“]*$")
_CLOSING_TAG = re.compile(r"</[a-zA-Z][\w-]*\s*>$")
_LINE_MARKUP = re.compile(r"&(?:#?\w{0,9}|[a-z]{1,4};?)$|=$|�$|\[[^\]\n]*\]\([^)\s]*$|!?\[[^\]\n]*$")
_OPEN_TAG = re.compile(r"<(?:/?[a-zA-Z][\w:-]*(?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*\s*(?:[\w:-]+\s*=\s*(?:\"[^\"]*|'[^']*)?)?/?|/|!-?)?$")
_OPEN_TAG_END = re.compile(r"<[a-zA-Z][^<>/]*>$")
_ENTITY_END = re.compile(r"&[a-zA-Z]{2,8};$|&#\w{1,7};$")
_ITEM = re.compile(r"(?:[-*•+▪]|\d{1,3}[.)]|[a-z][.)])[ \t]+(?=\S)")
_SCORE = re.compile(r"[^\W\d_][\w ]{0,24}: ?(\d+)(?:/(\d+)|( ?%))")
_LABEL = re.compile(r"([^\W\d_][\w ]{0,24}):\s+(.+)")
_DASH = re.compile(r"(?:–|—|--)\s*(?=\S)")
_LINK = re.compile(r"(?:https?://|www\.)\S+$")
_HEADING = re.compile(r"#{1,6}\s+\S")
_STOP = re.compile(r"[.!?]\s")
_RECORD = re.compile(r"\W?\d{2,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\W?\d{1,2}:\d{2}\b")
_SENTENCES = re.compile(r"(?<=[.!?。؟।])\s+")
_CLAUSE_SIGN = re.compile(r"[,;:–—]")
_CLAUSES = re.compile(r"(?<=[,;:–—])\s+")
_HOST = re.compile(r"(?:https?://|www\.)[^\s/]+")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_SPACE = re.compile(r"\s+")
_UNFINISHED = (",", ";", "-", "–", "—", "(", "“", "«", ":", "/")
_GOES_ON = re.compile(r"[,;]|[“«(][^”»)]*$")
#: A bare line of up to so many words may be a title or a name.
_BARE = 5

_SCHEMA = "part string, uid bigint, doc_id bigint, source string, status int, reason string, form int, kind string, unit string, clause string, chars bigint, bytes bigint, line boolean"
_NAMES = ["part", "uid", "doc_id", "source", "status", "reason", "form", "kind", "unit", "clause", "chars", "bytes", "line"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]


class Ending(NamedTuple):
    """How a text ends: ``status``, what decided it, and for open ones the closing unit."""

    status: int
    reason: str | None = None
    #: what an open ending counts as where nothing else decides
    form: int | None = None
    #: ``prose``, or the kind of a line that needs no full stop
    kind: str | None = None
    unit: str | None = None
    clause: str | None = None


def _plain(text: str) -> str:
    """Addresses masked and white space collapsed in a text whose numbers are masked already."""
    if "://" in text or "www." in text:
        text = _HOST.sub("@", text)
    return " ".join(text.split())


def masked(text: str) -> str:
    return _NUMBER.sub("0", _plain(text))


def _kind(line: str) -> tuple[str, str] | None:
    """The kind of a line that may stand without a full stop, and its value.

    The first characters tell cheaply which of the patterns can match."""
    c = line[:1]
    if (c in "-*•+▪" or c.isdigit() or line[1:2] in (".", ")")) and (m := _ITEM.match(line)):
        return "item", line[m.end() :]
    if c == "|":
        return "row", line
    if c == "#" and _HEADING.match(line):
        return "heading", line.lstrip("# ")
    if c in "–—-" and (m := _DASH.match(line)):
        return "signature", line[m.end() :]
    if ("://" in line or "www." in line) and _LINK.search(line):
        return "link", line
    if line.find(":", 1, 27) > 0 and (m := _LABEL.fullmatch(line)):
        label = m[1].lower()
        value = m[2]
        if "," not in value:
            return f"label {label}", value
        parts = value.split(",")
        if all(len(p.split()) <= 5 for p in parts) and not _STOP.search(value):
            return "tags", parts[-1].strip()
    return None


def _key(kind: str, value: str) -> str:
    return _key_of(kind, masked(value))


def _key_of(kind: str, value: str) -> str:
    return f"{'prose' if kind in ('link', 'prose') else kind}\x1f{value}"


def _is_record(line: str, before: str) -> bool:
    """A line of a log or of separated values, like the line before it."""
    if _RECORD.match(line) and (not before or _RECORD.match(before)):
        return True
    return any(before.count(s) == line.count(s) >= 2 for s in (",", ";", "\t")) and len(line.split()) < 4 * (1 + max(line.count(s) for s in (",", ";", "\t")))


def _open_markup(body: str) -> bool:
    """Whether the last tag or comment of a text does not close, however long it is."""
    if body.rfind("<!--") > body.rfind("-->"):
        return True
    at = body.rfind("<")
    if at <= body.rfind(">"):
        return False
    rest = body[at:]
    return bool(_OPEN_TAG.match(rest)) and (len(rest.split()) <= 2 or "=" in rest)


def ending(text: str) -> Ending:
    """How a non-blank text ends.

    ``CUT``: open markup or an open code block, or a sign that the rest was dropped.
    ``WHOLE``: a sentence, a code block, a closed tag, a table row or a score. ``OPEN``:
    anything else, with the closing unit: the line, or what follows its last sentence.
    Lines of a kind that needs no full stop, lines of records, closings of two short
    lines and bare lines of up to five words have the form ``WHOLE``, others ``CUT``.
    """
    body = text.rstrip()
    lines = body.rsplit("\n", 2)[-2:]
    line = lines[-1].strip()
    before = [x.strip() for x in lines[:-1]]
    if _SIGN.search("\n".join([before[-1] if before else "", line])):
        return Ending(CUT, "sign")
    if (body.count("\n```") + body.startswith("```")) % 2:
        return Ending(CUT, "markup")
    if line == "```":
        return Ending(WHOLE)
    if _CLOSING_TAG.search(line) or body.endswith("-->"):
        return Ending(WHOLE)
    if _LINE_MARKUP.search(line) or _ENTITY_END.search(line) or _OPEN_TAG_END.search(line) or _open_markup(body):
        return Ending(CUT, "markup")
    if line.startswith("|"):
        return Ending(WHOLE) if len(line) > 1 and line.endswith("|") else Ending(CUT, "markup")
    if m := _SCORE.fullmatch(line):
        return Ending(CUT, "ending") if m[2] and int(m[1]) > int(m[2]) else Ending(WHOLE)
    if _SENTENCE_END.search(line) and not _LINK.search(line):
        return Ending(WHOLE)
    if re.fullmatch(r"[-*_=]{3,}", line):
        return Ending(WHOLE)
    line = line.lstrip("> ")
    if (found := _kind(line)) and not (found[0].startswith("label") and len(found[1].split()) > 5):
        kind, value = found
        form = CUT if value.endswith(_UNFINISHED) and kind != "link" else WHOLE
        return Ending(OPEN, None, form, kind, _key(kind, value))
    unit = _SENTENCES.split(line)[-1]
    clause = _CLAUSES.split(unit)[-1]
    clause = _key("clause", clause) if clause and clause != unit else None
    form = CUT
    kind = "prose"
    if unit == line and not line.endswith(_UNFINISHED):
        above = before[-1] if before else ""
        short = len(line.split()) <= _BARE
        if short and above and len(above.split()) <= _BARE and not _SENTENCE_END.search(above):
            kind, form = "closing", WHOLE
        elif short and not above and not _GOES_ON.search(line) or _is_record(line, above):
            form = WHOLE
    return Ending(OPEN, None, form, kind, _key(kind, unit), clause)


def _whole_units(text: str, finished: bool) -> Iterator[tuple[str, bool]]:
    """``(key, is a line of its own)`` of the units that are known to be complete: all but
    the last one, and that too where the text is ``finished``. Clauses come without the
    first of a unit, which begins like the unit."""
    # hosts go first, as they may hold numbers
    text = text.rstrip()
    if "://" in text or "www." in text:
        text = _HOST.sub(lambda m: _NUMBER.sub("0", m[0]), text)
    lines = [x.strip().lstrip("> ") for x in _NUMBER.sub("0", text).split("\n")]
    for n, line in enumerate(lines):
        last = n + 1 == len(lines)
        if not line:
            continue
        found = _kind(line)
        if found and found[0] == "tags":
            values = line.split(":", 1)[1].split(",")
            for value in values if not last or finished else values[:-1]:
                yield _key_of("tags", _plain(value)), True
            continue
        if found and found[0] not in ("row", "link"):
            if not last or finished:
                yield _key_of(found[0], _plain(found[1])), True
            if not _STOP.search(found[1]):
                continue
        parts = _SENTENCES.split(line)
        alone = len(parts) == 1 and (n == 0 or not lines[n - 1]) and (last or not lines[n + 1])
        for part in parts if not last or finished else parts[:-1]:
            yield _key_of("prose", _plain(part)), alone and not _SENTENCE_END.search(part)
            if _CLAUSE_SIGN.search(part):
                for clause in _CLAUSES.split(part)[1:]:
                    yield _key_of("clause", _plain(clause)), False


def _classify(batches: Iterator[pa.RecordBatch], flush_at: int = 200_000) -> Iterator[pa.RecordBatch]:
    seen: dict[str, bool] = {}

    def out(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    def units():
        rows = [("unit", None, None, None, None, None, None, None, key, None, None, None, line) for key, line in seen.items()]
        seen.clear()
        return out(rows)

    for batch in batches:
        rows = []
        for uid, doc, source, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if not text or not text.strip():
                continue
            e = ending(text)
            rows.append(("doc", uid, doc, source, e.status, e.reason, e.form, e.kind, e.unit, e.clause, len(text), len(text.encode("utf-8", "surrogatepass")), None))
            for key, line in _whole_units(text, e.status == WHOLE):
                seen[key] = seen.get(key, False) or line
        if rows:
            yield out(rows)
        if len(seen) > flush_at:
            yield units()
    if seen:
        yield units()


def truncation(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", limit_cases: int = 4, limit_share: float = 0.05, common: int = 3, common_share: float = 0.01) -> DataFrame:
    """``doc_id, source, is_cut, reason`` for every document with a text that is not blank.

    ``reason`` says what decided: ``sign`` or ``markup``, a longer ``copy`` of the closing
    unit or of its last ``clause``, a cutting ``limit`` of the source, or the form of the
    ``ending``; null for whole texts. Null, empty and blank texts are left out; a null
    source is kept as null; repeated rows give repeated rows. ``limit_cases``: a source is
    taken to cut at an exact length in characters or bytes if so many of its texts of that
    length, and ``limit_share`` of all its cut texts, are cut there; endings of that length
    that are still open then count as cut. ``common``: a line in which so many texts end, not all
    of one length, and ``common_share`` of all that end in a line of its kind, is whole; one of prose only
    if it has no longer copy.
    """
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    scanned = cut_lineage(base.mapInArrow(_classify, _SCHEMA))
    rows = scanned.filter("part = 'doc'").drop("part", "line")
    open_rows = rows.filter(F.col("status") == OPEN)

    # copies of one cut text end alike and are equally long
    ends = open_rows.groupBy("kind", "unit").agg(F.count("*").alias("n"), (F.min("chars") < F.max("chars")).alias("several"))
    totals = ends.groupBy("kind").agg(F.sum("n").alias("total"))
    ends = cut_lineage(ends.join(totals, "kind").withColumn("common", F.col("several") & (F.col("n") >= common) & (F.col("n") >= common_share * F.col("total"))))
    clauses = open_rows.filter("clause is not null").groupBy(F.col("clause").alias("value")).agg(F.count("*").alias("n"))
    whole = scanned.filter("part = 'unit'").groupBy(F.col("unit").alias("value")).agg(F.max("line").alias("line"))
    no, yes = F.lit(False), F.lit(True)
    asked = ends.select(F.col("unit").alias("value"), yes.alias("asked"), F.col("common").alias("whole")).unionByName(clauses.select("value", yes.alias("asked"), no.alias("whole")))
    longer = values_with_longer(asked.unionByName(whole.select("value", no.alias("asked"), yes.alias("whole")))).withColumn("longer", yes)
    lines = whole.filter("line").select("value", yes.alias("known"))

    unit_facts = ends.withColumnRenamed("unit", "value").join(lines, "value", "left").join(longer, "value", "left")
    known = F.coalesce("known", no) | F.col("common") & (F.col("kind") != "prose")
    unit_facts = unit_facts.groupBy("value").agg(F.sum("n").alias("n"), F.max(known).alias("known"), F.max(F.coalesce("longer", no)).alias("longer"), F.max("common").alias("common"))
    clause_facts = clauses.join(longer, "value").select("value", "n", F.col("longer").alias("clause_longer"))
    units = attach_classes(open_rows.withColumn("value", F.col("unit")), unit_facts, "value", "n", "uid").drop("value")
    units = attach_classes(units.withColumn("value", F.col("clause")), clause_facts, "value", "n", "uid").drop("value")
    verdict = F.when(F.col("known"), F.struct(F.lit(WHOLE).alias("status"), F.lit(None).cast("string").alias("reason")))
    verdict = verdict.when(F.col("longer"), F.struct(F.lit(CUT).alias("status"), F.lit("copy").alias("reason")))
    verdict = verdict.when(F.col("common"), F.struct(F.lit(WHOLE).alias("status"), F.lit(None).cast("string").alias("reason")))
    verdict = verdict.when(F.col("clause_longer") & (F.col("form") == CUT), F.struct(F.lit(CUT).alias("status"), F.lit("clause").alias("reason")))
    judged = units.withColumn("_v", verdict).withColumn("status", F.coalesce("_v.status", "status")).withColumn("reason", F.col("_v.reason"))
    columns = ["uid", "doc_id", "source", "status", "reason", "form", "chars", "bytes"]
    judged = cut_lineage(rows.filter(F.col("status") != OPEN).select(columns).unionByName(judged.select(columns)))

    # lengths at which a source cuts: form counts here as well, as most cuts show in it
    plain = F.coalesce(F.when(F.col("status") == OPEN, F.col("form")), F.col("status")) == CUT
    limits = None
    for measure in ("chars", "bytes"):
        per_length = judged.groupBy("source", measure).agg(F.count_if(plain).alias("_cut"), F.count("*").alias("n"))
        per_source = per_length.groupBy(F.col("source").alias("_s")).agg(F.sum("_cut").alias("_total"))
        spikes = per_length.join(per_source, F.col("source").eqNullSafe(F.col("_s")))
        spikes = spikes.filter((F.col("_cut") >= limit_cases) & (F.col("_cut") >= limit_share * F.col("_total")) & (F.col("_cut") * 2 >= F.col("n")))
        spikes = spikes.select(_length_key(measure).alias("value"), "n", yes.alias(f"limit_{measure}"))
        limits = attach_classes((judged if limits is None else limits).withColumn("value", F.when(F.col("status") == OPEN, _length_key(measure))), spikes, "value", "n", "uid").drop("value")
    at_limit = F.coalesce("limit_chars", no) | F.coalesce("limit_bytes", no)
    is_cut = F.when(F.col("status") == OPEN, at_limit | (F.col("form") == CUT)).otherwise(F.col("status") == CUT)
    why = F.when(F.col("status") == OPEN, F.when(at_limit, F.lit("limit")).otherwise("ending")).otherwise(F.col("reason"))
    return limits.select("doc_id", "source", is_cut.alias("is_cut"), F.when(is_cut, why).alias("reason"))


def _length_key(measure: str):
    return F.concat_ws("\x1f", F.coalesce("source", F.lit("\x00")), F.col(measure).cast("string"))


def by_source(verdicts: DataFrame) -> DataFrame:
    """``source, n_texts, n_cut, share_cut`` of ``truncation``'s rows."""
    return verdicts.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("is_cut").alias("n_cut"), (F.count_if("is_cut") / F.count("*")).alias("share_cut"))
