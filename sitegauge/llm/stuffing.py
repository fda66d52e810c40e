"""Keyword-stuffed pages, link lists and tag pages (problem 1).

One scan splits every page's own content into prose and list material and counts the
words and neighbouring pairs of all pages. Pages that are nearly all list material
then get the mean pointwise mutual information of their neighbouring words, from the
counts of the whole corpus without the page itself. As rare words have high values
whatever they stand next to, every pair is measured against the mean of all pairs of
words as frequent as its own: word salad lies well below it. The share of pairs that
repeat within the page tells repeated collocations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.markup import Block, blocks
from sitegauge.llm.residue import has_residue
from sitegauge.llm.skew import join_classes
from sitegauge.session import cut_lineage

_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?]+[\"”’»)\]]*(?:\s+|$)|[。！？]+[」』”]?")
_COMMA = re.compile(r"[,;]+(?:\s|$)|\s(?:[|/•·»>]+|[-–—])\s")
_SEPARATORS = ",;|/•·»>-–—"
_TAG = re.compile(r"(?<!\S)#\w+|(?<!\S)\w+(?:-\w+){2,}(?!\S)")
_NO_SPACES = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_SKIPPED = frozenset(("title", "button", "label", "option", "noscript", "legend"))

_NAMES = ["kind", "page_id", "first", "second", "n", "share", "pairs", "repeated", "tags", "sentences"]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
_SCHEMA = "kind string, page_id bigint, first string, second string, n bigint, share double, pairs bigint, repeated double, tags bigint, sentences bigint"


def _length(part: str, spaced: bool = True) -> int:
    """Words of a part; two characters make one in scripts without spaces."""
    n = len(part.split())
    return n if spaced else n + len(_NO_SPACES.findall(part)) // 2


def _run_on(part: str) -> bool:
    # twenty words and the blanks between them
    if len(part) < 39:
        return False
    found = part.lower().split()
    if len(found) < 20:
        return False
    return len(set(found)) < 0.65 * len(found) or len(found) > 40 and any(_length(x) > 40 for x in _COMMA.split(part))


def is_prose(block: Block) -> bool:
    """Whether a block reads as sentences.

    It is not linked for the most part, half of its parts or more end as sentences, and
    such a part has six words in the middle, in phrases of more than keyword length. A run
    of over 40 words without punctuation, or of 20 or more that keeps repeating words, is
    no sentence, full stop or not.
    """
    if block.kind == "alt" or block.linked * 2 >= len(block.text):
        return False
    ends = [m.end() for m in _END.finditer(block.text)]
    if not ends:
        return False
    ended = [p for a, b in zip([0, *ends], ends) if not _run_on(p := block.text[a:b])]
    if len(ended) * 2 < len(ends) + (ends[-1] < len(block.text)) or not ended:
        return False
    spaced = block.text.isascii() or not _NO_SPACES.search(block.text)
    lengths = [_length(p, spaced) for p in ended]
    if median(lengths) < 6:
        return False
    size = sum(lengths)
    # every separator holds one of these signs, so more phrases than that there are not
    signs = len(ended) + sum(map(block.text.count, _SEPARATORS))
    if signs < 6 or size >= 3.5 * signs:
        return True
    phrases = sum(map(len, map(_COMMA.findall, ended))) + len(ended)
    return not (phrases >= 6 and size < 3.5 * phrases)


def own_content(html: str) -> list[Block]:
    """The page's own blocks and picture descriptions, without head, menu and footer."""
    return [b for b in blocks(html, alts=True) if b.region not in ("nav", "footer") and b.kind not in _SKIPPED and not b.noscript]


def _scan(batches: Iterator[pa.RecordBatch], share: float, least: int, flush_at: int) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()
    pairs: Counter[tuple[str, str]] = Counter()

    def out(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    def counts() -> Iterator[pa.RecordBatch]:
        nothing = (None,) * 5
        rows = [("word", None, w, None, n, *nothing) for w, n in words.items()]
        rows += [("pair", None, a, b, n, *nothing) for (a, b), n in pairs.items()]
        words.clear()
        pairs.clear()
        if rows:
            yield out(rows)

    for batch in batches:
        rows: list[tuple] = []
        for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not html:
                continue
            shown: list[tuple[str, list[str], bool]] = []
            list_size = size = tags = sentences = 0
            last = None
            for b in own_content(html):
                found = _WORD.findall(b.text.lower())
                words.update(found)
                pairs.update(zip(found, found[1:]))
                size += len(b.text)
                if is_prose(b):
                    sentences += len(_END.findall(b.text))
                    shown.append((b.text, found, True))
                    last = None
                else:
                    list_size += len(b.text)
                    shown.append((b.text, found, False))
                    tags += len(_TAG.findall(b.text))
                    # items of one word have their neighbours in other items
                    if found:
                        if last is not None:
                            pairs[last, found[0]] += 1
                        last = found[-1]
            if size and list_size >= share * size:
                own: Counter[tuple[str, str]] = Counter()
                last = None
                for text, found, prose in shown:
                    # unfilled templates are no keywords
                    if found and not has_residue(text):
                        run = found if prose or last is None else [last, *found]
                        own.update(zip(run, run[1:]))
                        last = None if prose else found[-1]
                total = sum(own.values())
                if total + tags >= least:
                    rows.append(("page", page, None, None, None, list_size / size, total, 1 - len(own) / max(total, 1), tags, sentences))
                    rows.extend(("own", page, a, b, n, None, None, None, None, None) for (a, b), n in own.items())
                    if len(rows) > 100_000:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)
        if len(pairs) > flush_at:
            yield from counts()
    yield from counts()


def stuffed_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    html: str = "html",
    share: float = 0.8,
    least: int = 20,
    incoherent: float = -0.35,
    repeated: float = 0.3,
    tags: int = 10,
    flush_at: int = 500_000,
) -> DataFrame:
    """``page_id, share, pairs, repeated, tags, sentences, mean_pmi, coherence, stuffed, reason``
    of every page whose own content is list material for ``share`` or more, by length.

    ``coherence`` is the mean PMI of the page's neighbouring words less that of pairs of
    words as frequent, in natural logarithms. ``reason`` is ``salad`` where it is
    ``incoherent`` or less, else ``repetition`` where at least the share ``repeated`` of the
    pairs are repeats, else ``tags`` where there are so many glued tags; ``stuffed`` are
    the pages with a reason. Fewer than ``least`` pairs and tags are too little to be
    keywords. Null and empty html gives no rows; repeated rows are reported each; other
    columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html).cast("string").alias("html"))
    scanned = cut_lineage(rows.mapInArrow(lambda b: _scan(b, share, least, flush_at), _SCHEMA))
    words = cut_lineage(scanned.filter("kind = 'word'").groupBy("first").agg(F.sum("n").alias("n")))
    pairs = scanned.filter("kind = 'pair'").groupBy("first", "second").agg(F.sum("n").alias("n"))
    totals = scanned.filter("kind in ('word', 'pair')").groupBy("kind").agg(F.sum("n").alias("n")).collect()
    total = {r["kind"]: r["n"] for r in totals}
    scale = float(total.get("word", 1)) ** 2 / float(total.get("pair", 1))
    # the commonest words have followers without number: their rows are salted
    counted = join_classes(pairs, words.withColumn("n1", F.col("n")).select("first", "n1"), "first", F.col("n1"), "second")
    counted = join_classes(counted, words.select(F.col("first").alias("second"), F.col("n").alias("n2")), "second", F.col("n2"), "first")
    level = F.struct(*[F.floor(F.log2(c)).cast("int").alias(c) for c in ("n1", "n2")])
    # log2 of a count is below 64, so this table has less than 4,096 rows
    counted = cut_lineage(counted.withColumn("level", level))
    pmi = F.log(F.col("n") * F.lit(scale) / (F.col("n1").cast("double") * F.col("n2")))
    expected = counted.groupBy("level").agg((F.sum(F.col("n") * pmi) / F.sum("n")).alias("expected"))
    key = F.concat_ws(" ", "first", "second")
    own = scanned.filter("kind = 'own'").select("page_id", key.alias("pair"), F.col("n").alias("here"))
    wanted = own.select("pair").distinct()
    known = counted.withColumn("pair", key).join(wanted, "pair", "left_semi").join(F.broadcast(expected), "level")
    known = known.select("pair", F.col("n").alias("everywhere"), (F.lit(scale) / (F.col("n1").cast("double") * F.col("n2"))).alias("factor"), "expected")
    own = join_classes(own, known, "pair", F.col("everywhere"), "page_id")
    elsewhere = F.log(F.greatest(F.col("everywhere") - F.col("here"), F.lit(0.5)) * F.col("factor"))
    weight = F.sum("here")
    mean = own.groupBy("page_id").agg((F.sum(F.col("here") * elsewhere) / weight).alias("mean_pmi"), (F.sum(F.col("here") * (elsewhere - F.col("expected"))) / weight).alias("coherence"))
    found = scanned.filter("kind = 'page'").select("page_id", "share", "pairs", "repeated", "tags", "sentences").join(mean, "page_id", "left")
    reason = F.when(F.col("coherence") <= incoherent, "salad").when(F.col("repeated") >= repeated, "repetition").when(F.col("tags") >= tags, "tags")
    return found.withColumn("reason", reason).withColumn("stuffed", F.col("reason").isNotNull())
