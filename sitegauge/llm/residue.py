"""Template residue, filler and error-page text (problem 3).

Unfilled placeholders and filler are found by rules in the title, the headings and
the visible text. For notices, every record is reduced to its messages; numbers,
addresses and dates are masked and messages with the same exact normalised hash are
grouped across sources. A group is a notice by its phrase, by a weaker phrase and its
recurrence over several sources, or, in any language, because pages that hold nothing
else recur over many of them. A page whose messages are notices and little else has
nothing to say.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.markup import Block, blocks
from sitegauge.llm.skew import join_classes
from sitegauge.session import cut_lineage

PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^%{}\n]+%\}|<%[=\-#]?[^%<>\n]+%>|[$#]\{[^{}\n]+\}"
    r"|\[\[[A-Za-z][\w.\- ]*[_.A-Z][\w.\-]*\]\]|%%[A-Za-z][\w.]+%%|(?<![\w%])%[A-Z][A-Z_]{2,}%(?![\w%])"
    r"|@@[A-Za-z][\w.]+@@|(?<!\w)__[A-Z][A-Z0-9_]*[A-Z0-9]__(?!\w)|(?<![\w$#{%])\{(?:[a-z][a-zA-Z]*(?:[_.][a-zA-Z]\w*)*|\d)\}(?![}\w])"
    r"|\[(?i:insert|your|enter|add|put|replace)\s[^\[\]\n]{2,}\]|<[A-Z][A-Z_]+(?: [A-Z][A-Z_]+)+>"
)
FILLER = re.compile(
    r"lorem ipsum|\bplaceholder (?:copy|text|content)\b|\btext to follow\b|\b(?:headline|title|text|copy|content|description|image|name) (?:goes|comes) here\b"
    r"|\bclick to edit\b|\byour (?:own )?(?:text|story|content) here\b|\breplace this (?:text|copy|paragraph)\b|\bdefault (?:block|text|paragraph)\b|\b(?:copy|text|content) to come\b"
    r"|\bdescribe your (?:product|business|company|service)\b.*\bhere\b|\bblah blah\b|\b(?:asdf|qwer|sdfg)\b(?:\s+(?:asdf|qwer|sdfg)\b)+|\b(xx+)(?:\s+\1\b)+"
    r"|^\W*(?:todo|tbd|fixme)\b[:\s]+(?:write|add|fill|insert|intro|text|copy|update)|^(?:new|untitled|sample|test) (?:page|document|post|heading)(?: \d+)?$|^sample (?:paragraph|text)\b",
    re.I,
)
#: Every match of FILLER holds one of these, every match of PLACEHOLDER one of the next.
_FILLER_CUES = tuple("lorem ipsum|placeholder |to follow| here|click to edit|replace this|default |to come|blah|asdf|qwer|sdfg|xx|todo|tbd|fixme|new p|new d|new h|untitled |sample |test p|test d|test h".split("|"))
_PLACEHOLDER_CUES = ("{", "%", "[", "@@", "__", "<")
#: Words of the usual Latin filler (fixed values).
LATIN = frozenset(
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu ex "
    "excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui "
    "quis reprehenderit sed sint sit sunt tempor ullamco ut velit veniam voluptate".split()
)
_LATIN_RARE = LATIN - frozenset("ad do ea est et eu ex id in non qui sed sit ut culpa magna esse dolor nulla elit commodo".split())
_WORD = re.compile(r"[^\W_]+")
_MASKS = (
    (re.compile(r"https?://\S+|www\.\S+|\b[\w.+-]+@[\w-]+\.[\w.]+|(?<!\w)/(?:[\w.-]+/)+[\w.-]*"), "@"),
    (re.compile(r"\b(?=\w*\d)\w+(?:[-:./]\w*\d\w*)*"), "0"),
)
_SERVER = re.compile(r"[\w.-]+/\d[\w.]*")
_STATUS = re.compile(r"^\s*(?:status|http(?:/\d(?:\.\d)?)?|error)\s*\d{3}\s*[:\-–]\s*", re.I)

#: Phrases by which a message is a notice whatever its frequency (on masked lower case).
STRONG = "|".join(
    (
        r"\b(?:enable|turn on|activate|allow|requires?|needs?)\b.{0,30}\b(?:javascript|scripts?)\b",
        r"\b(?:javascript|scripts?|cookies) (?:is|are|must be|seems? to be|has been) (?:disabled|off|turned off|switched off|blocked|required|enabled)",
        r"\bpage (?:was |has |is |has been |could not be |cannot be )?(?:not found|moved|removed|found|missing|gone)\b|\b(?:not|never) find (?:that|the|this|your) page|nothing (?:lives|is|here) at this address|page (?:does not|doesn.t) exist",
        r"\bbad gateway\b|service (?:is )?(?:temporarily )?unavailable|internal server error|gateway time-?out|\berror 0\b.{0,40}(?:side|server|wrong|broke)|something (?:broke|went wrong)",
        r"(?:database|connection|query).{0,20}failed (?:in|at)\b|^fatal(?: error)?:|call to undefined (?:function|method)|uncaught (?:exception|error)|stack trace",
        r"\baccess (?:is )?denied\b|(?:request|address|visit) (?:was|has been|is) blocked|\bforbidden\b.{0,40}(?:permission|server|access)|too many requests",
        r"down for maintenance|under maintenance|(?:be|come) back soon|session (?:has )?(?:expired|ended|timed out)|confirm (?:that )?you(?: are|.re) (?:a )?human|(?:verify|prove) (?:that )?you(?: are|.re) (?:a )?(?:human|not a robot)|checking your browser",
        r"domain (?:is|has been) (?:parked|for sale)|site (?:is )?(?:under construction|coming soon)",
        r"aktivieren sie (?:bitte )?javascript|javascript (?:ist|muss)|wegen wartung|nicht erreichbar|seite (?:wurde |konnte |.{0,12})?.{0,12}nicht gefunden|seite existiert nicht|zugriff verweigert|interner serverfehler|zu viele anfragen|sitzung ist abgelaufen",
        r"activer javascript|page (?:demandée )?(?:est |reste )?introuvable|page n.(?:existe pas|a pas été trouvée)|accès (?:refusé|interdit)|erreur interne|en maintenance|trop de requêtes|session a expiré|service indisponible",
        r"(?:active|activa|habilite) javascript|acceso denegado|en mantenimiento|página no (?:encontrada|existe)|no (?:se )?(?:encontró|encuentra|encontramos|hemos encontrado) (?:la|esta|esa) página|error interno|demasiadas solicitudes|sesión ha (?:expirado|caducado)|servicio no disponible",
        r"(?:ative|habilite) o javascript|acesso negado|em manutenção|página não (?:foi )?(?:encontrada|existe)|não encontramos (?:a|esta|essa) página|erro interno|solicitações demais|sessão expirou|serviço indisponível",
        r"включите javascript|страница не найдена|временно недоступ|доступ запрещ|ошибка сервера|технические работы|не удалось найти страницу|слишком много запросов|сеанс ист[её]к",
    )
)
#: Cues that make a message a notice only where it recurs over several sources.
WEAK = r"\b(?:error|unavailable|denied|blocked|expired|forbidden|maintenance|try again|disabled|not found|captcha|robot|javascript|erreur|fehler|erro|ошибка)\b"

#: What a long message goes on with if it is the trace of an error.
TRACE = r"\bat [\w.$<>]+\(|\bline 0\b|\btraceback\b|\bstack trace\b|^\W*(?:#0|caused by)\b"

_STRONG, _WEAK, _TRACE = re.compile(STRONG), re.compile(WEAK), re.compile(TRACE, re.M)
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
#: Longer messages are notices only by their first sentence, and as traces.
_LONG = 60

_SCHEMA = "page_id bigint, host string, field string, kind string, message binary, strength int, n_words int"
_NAMES = ["page_id", "host", "field", "kind", "message", "strength", "n_words"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32()]


def masked(text: str) -> str:
    """Lower case with numbers, dates, codes and addresses masked."""
    for pattern, stand_in in _MASKS:
        text = pattern.sub(stand_in, text)
    return text.lower()


def is_latin_filler(text: str) -> bool:
    found = _WORD.findall(text.lower())
    if len(found) < 4:
        return False
    return sum(w in LATIN for w in found) >= 0.8 * len(found) and len({w for w in found if w in _LATIN_RARE}) >= 2


def has_residue(text: str) -> bool:
    """Whether a text of single spaces holds an unfilled placeholder or filler.

    The patterns run only where one of their literal cues occurs, which loses no match.
    """
    if any(c in text for c in _PLACEHOLDER_CUES) and PLACEHOLDER.search(text):
        return True
    low = text.lower()
    if any(c in low for c in _FILLER_CUES) and FILLER.search(text):
        return True
    if sum(w in low for w in _LATIN_RARE) < 2:
        return False
    return any(map(is_latin_filler, re.split(r"(?<=[.!?])\s+", text)))


def _page_has_residue(found: list[Block]) -> bool:
    shown = [b.text for b in found if not b.code and not b.noscript]
    whole = "\n".join(shown)
    low = whole.lower()
    if not any(c in whole for c in _PLACEHOLDER_CUES) and not any(c in low for c in _FILLER_CUES) and sum(w in low for w in _LATIN_RARE) < 2:
        return False
    return any(map(has_residue, shown))


def _messages(found: list[Block]) -> list[str]:
    """The distinct messages of a page's own content, else its title."""
    own = list(dict.fromkeys(b.text for b in found if not b.region and b.kind not in ("title", "label", "button", "option", "alt") and b.linked < 0.8 * len(b.text) and not _SERVER.fullmatch(b.text)))
    return own or [b.text for b in found if b.kind == "title"]


def strength(form: str, n_words: int, weak_words: int) -> int:
    """2 for a masked message that its phrase makes a notice, 1 for one with a weak cue, else 0."""
    if n_words > _LONG:
        return 2 if _STRONG.search(_SENTENCE.split(form, maxsplit=1)[0]) and _TRACE.search(form) else 0
    if _STRONG.search(form):
        return 2
    return 1 if n_words <= weak_words and _WEAK.search(form) else 0


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _page_units(found: list[Block], other_words: int, weak_words: int, page_words: int) -> list[tuple]:
    """``kind, message, strength, n_words`` of a page that may have nothing to say.

    A page of over ``page_words`` words with more than ``other_words`` in messages without
    any cue has, whatever recurs, so reading stops there; nothing is lost by it."""
    units, forms = [], []
    words = others = 0
    for text in _messages(found):
        n = len(_WORD.findall(text))
        form = masked(text)
        degree = strength(form, n, weak_words)
        words += n
        others += 0 if degree else n
        if others > other_words and words > page_words:
            return []
        forms.append(form)
        units.append(("message", _digest(form), degree, n))
    if forms and words <= page_words:
        units.append(("page", _digest("\x00".join(["", *sorted(forms)])), 0, words))
    return units


def _extract(batches: Iterator[pa.RecordBatch], other_words: int, weak_words: int, page_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for page, host, html, error in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if html and html.strip():
                found = blocks(html)
                if _page_has_residue(found):
                    rows.append((page, host, "html", "template", None, None, None))
                else:
                    rows.extend((page, host, "html", *unit) for unit in _page_units(found, other_words, weak_words, page_words))
            if error and error.strip():
                if PLACEHOLDER.search(error) or FILLER.search(error):
                    rows.append((page, host, "fetch_error", "template", None, None, None))
                else:
                    # the sentences of a page that the fetcher passed on
                    for text in dict.fromkeys(x for b in blocks(error) if b.kind != "alt" for x in (b.text, *_SENTENCE.split(b.text))):
                        form = masked(_STATUS.sub("", text))
                        n = len(_WORD.findall(form))
                        if n:
                            rows.append((page, host, "fetch_error", "message", _digest(form), strength(form, n, weak_words), n))
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def residue(pages: DataFrame, other_words: int = 6, sources: int = 3, weak_words: int = 8, page_words: int = 40, page_sources: int = 5) -> DataFrame:
    """``page_id, field, reason`` of the records of ``page_id, host, html, fetch_error`` that
    hold residue (``template``) or nothing but a notice, known by the ``recurrence`` of the
    whole page or else by a ``phrase``.

    A page with more than ``other_words`` words beside its notices has something to say. In
    ``fetch_error`` one notice is enough; the fetcher's own reasons are no notices, as no
    page shows them. A message is a notice by its phrase (``STRONG``); with weak cues and up
    to ``weak_words`` words if at least ``sources`` hosts show it on pages that say nothing
    else; a page of up to ``page_words`` words, in any language, if its whole content
    recurs over ``page_sources`` hosts. Messages of more than sixty words are
    notices if they begin as one and go on as a trace. Null,
    empty and blank texts hold nothing; a null host is a source of its own; a repeated
    row is reported once; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("host").cast("string").alias("host"), F.col("html").cast("string").alias("html"), F.col("fetch_error").cast("string").alias("fetch_error"))
    scanned = cut_lineage(rows.mapInArrow(lambda b: _extract(b, other_words, weak_words, page_words), _SCHEMA))
    units = scanned.filter("kind <> 'template'")
    # both counts are pre-aggregated per host, so a message that a third of all pages show is few rows
    per_host = units.groupBy("message", "host").agg(F.count("*").alias("n"), F.count_if(F.col("field") == "html").alias("shown"), F.max("strength").alias("strength"), F.max("kind").alias("kind"))
    messages = per_host.groupBy("message").agg(F.sum("n").alias("n"), F.count_if(F.col("shown") > 0).alias("n_hosts"), F.max("strength").alias("strength"), F.max("kind").alias("kind"))
    by_phrase = (F.col("kind") == "message") & ((F.col("strength") == 2) | (F.col("strength") == 1) & (F.col("n_hosts") >= sources))
    classes = messages.select("message", "n", by_phrase.alias("notice"), ((F.col("kind") == "page") & (F.col("n_hosts") >= page_sources)).alias("alone"))
    judged = join_classes(units.select("page_id", "field", "kind", "message", "n_words"), classes, "message", F.col("n"), "page_id")
    others = F.sum(F.when((F.col("kind") == "message") & ~F.col("notice"), F.col("n_words")).otherwise(0))
    per_page = judged.groupBy("page_id", "field").agg(F.max("notice").alias("notice"), others.alias("others"), F.max("alone").alias("alone"))
    only = per_page.filter("alone or notice").filter((F.col("field") == "fetch_error") | F.col("alone") | (F.col("others") <= other_words))
    template = scanned.filter("kind = 'template'").select("page_id", "field").distinct()
    return template.select("page_id", "field", F.lit("template").alias("reason")).unionByName(only.select("page_id", "field", F.when(F.col("alone"), "recurrence").otherwise("phrase").alias("reason")))


def clean_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The pages without those reported."""
    return pages.join(found.select("page_id").distinct(), "page_id", "left_anti")
