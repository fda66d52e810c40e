"""Cutting oversized texts at natural boundaries (problem 5).

Each oversized text is cut by dynamic programming over its boundary positions, of which
only ends of tags, blanks and plain characters are thinned out: the
chosen cuts minimise the sum of cut penalties and of squared size imbalance, subject
to the capacity, every piece after the first repeating the end of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = rb"(?:address|article|aside|blockquote|body|center|dd|details|dialog|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|template|tfoot|th|thead|tr|ul)"
#: (kind, penalty, pattern or bytes of which a run is one, cut after the match rather than before it), best first.
BOUNDARIES: list[tuple[str, float, re.Pattern[bytes] | bytes, bool]] = [
    ("section", 0.0, re.compile(rb"<(?:main|section|article|header|footer|nav|aside|h[1-6]|body|table)\b", re.I), False),
    ("section", 0.0, re.compile(rb"</(?:main|section|article|header|footer|nav|aside|table|script|style)\s*>", re.I), True),
    ("block", 1.0, re.compile(rb"</" + _BLOCK + rb"\s*>|\n[ \t]*\r?\n", re.I), True),
    ("block", 1.0, re.compile(rb"<" + _BLOCK + rb"\b", re.I), False),
    ("sentence", 4.0, re.compile(rb"(?:[.!?]|\xe3\x80\x82)(?:[\"')\]]|\xe2\x80\x9d|\xe2\x80\x99|\xc2\xbb)?\s+"), True),
    ("line", 5.0, b"\n", True),
    ("tag", 6.0, b">", True),
    ("space", 10.0, b" \t", True),
]
#: Boundaries from here on are so dense that the best of a few bytes stands for them.
_THINNED = 6
ANYWHERE = ("character", 40.0)
IN_TAG = 25.0
_TAG = re.compile(rb"<[a-zA-Z/!][^<>]*>")

_NAMES = ["budget_id", "id", "piece_no", "n_pieces", "from_byte", "to_byte", "overlap_bytes", "cut", "piece"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
_SCHEMA = "budget_id int, id bigint, piece_no int, n_pieces int, from_byte bigint, to_byte bigint, overlap_bytes int, cut string, piece string"


def _candidates(data: bytes, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, penalties and kinds of all boundaries of blocks, sentences and lines, and of
    the best one of the others (ends of tags, blanks, any character) in every ``step`` bytes."""
    n = len(data)
    penalty = np.full(n + 1, np.inf)
    kind = np.full(n + 1, -1, np.int8)
    raw = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    penalty[starts] = ANYWHERE[1]
    for k in range(len(BOUNDARIES) - 1, -1, -1):
        _, cost, pattern, after = BOUNDARIES[k]
        if isinstance(pattern, bytes):
            own = np.isin(raw, np.frombuffer(pattern, np.uint8))
            if len(pattern) > 1:  # a run ends where the next byte is none of them
                own &= ~np.append(own[1:], False)
            at = np.flatnonzero(own) + 1
        elif after:
            at = np.array([m.end() for m in pattern.finditer(data)], np.int64)
        else:
            at = np.array([m.start() for m in pattern.finditer(data)], np.int64)
        penalty[at] = np.minimum(penalty[at], cost) if k >= 4 else cost
        kind[at] = k
    inside = np.zeros(n + 2, np.int32)
    spans = [m.span() for m in _TAG.finditer(data)]
    if spans:
        edges = np.array(spans)
        np.add.at(inside, edges[:, 0] + 1, 1)
        np.add.at(inside, edges[:, 1], -1)
        penalty[(np.cumsum(inside)[: n + 1] > 0) & np.isfinite(penalty)] += IN_TAG
    buckets = np.arange(n + 1) // step
    order = np.lexsort((np.arange(n + 1), penalty, buckets))
    first = order[np.unique(buckets[order], return_index=True)[1]]
    first = first[np.isfinite(penalty[first])]
    natural = np.flatnonzero((kind >= 0) & (kind < _THINNED) & np.isfinite(penalty))
    positions = np.unique(np.concatenate([[0], first, natural, [n]]))
    return positions, penalty[positions], kind[positions]


def cut(text: str, capacity: int, overlap: int, known: dict | None = None) -> list[tuple[int, int, int, str]]:
    """``(from, to, overlap, kind)`` in UTF-8 bytes of each piece, in order.

    ``from`` includes the overlap, which is ``overlap`` bytes, or up to three more where
    it would otherwise begin inside a character. ``kind`` names the boundary the piece
    ends at. A text within the capacity is one piece. ``known`` keeps the boundaries of
    the text from one capacity to the next.
    """
    data = text.encode("utf-8")
    n = len(data)
    if n <= capacity:
        return [(0, n, 0, "end")]
    if capacity - overlap < 16:
        raise ValueError("a capacity must exceed its overlap by 16 bytes or more")
    step = max(4, min(48, (capacity - overlap) // 64))
    known = {} if known is None else known
    if step not in known:
        known[step] = _candidates(data, step)
    positions, penalties, kinds = known[step]
    raw = np.frombuffer(data, np.uint8)
    begins = np.maximum(positions - overlap, 0)
    for _ in range(3):
        inner = (begins > 0) & ((raw[np.minimum(begins, n - 1)] & 0xC0) == 0x80)
        begins[inner] -= 1
    begins[0] = 0
    pieces = -(-(n - overlap) // (capacity - overlap))
    target = (n + (pieces - 1) * overlap) / pieces
    m = len(positions)
    best = np.full(m, np.inf)
    back = np.zeros(m, np.int64)
    best[0] = 0.0
    lows = np.searchsorted(begins, positions - capacity, side="left")
    penalties = penalties.copy()
    penalties[-1] = 0.0
    # in units of the target size; a piece must reach beyond its overlap, which positions in
    # ascending order ensure
    ends_at, begin_at = positions / target - 1.0, begins / target
    for j, low in enumerate(lows.tolist()):
        if 0 <= low < j:
            off = ends_at[j] - begin_at[low:j]
            costs = off * off
            costs *= 40.0
            costs += best[low:j]
            k = int(costs.argmin())
            best[j] = costs[k] + penalties[j] + 5.0
            back[j] = low + k
    ends = [m - 1]
    while ends[-1]:
        ends.append(int(back[ends[-1]]))
    ends.reverse()
    names = [b[0] for b in BOUNDARIES]
    out = []
    for a, b in zip(ends, ends[1:]):
        name = "end" if b == m - 1 else names[kinds[b]] if kinds[b] >= 0 else ANYWHERE[0]
        out.append((int(begins[a]), int(positions[b]), int(positions[a] - begins[a]), name))
    return out


def _split(batches: Iterator[pa.RecordBatch], budgets: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = text.encode("utf-8")
            rows = []
            known: dict = {}
            for budget, capacity, overlap in budgets:
                if len(data) > capacity:
                    pieces = cut(text, capacity, overlap, known)
                    rows.extend((budget, id_, k, len(pieces), a, b, o, kind, data[a:b].decode("utf-8")) for k, (a, b, o, kind) in enumerate(pieces))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def split_oversized(df: DataFrame, budgets: DataFrame, id_col: str, text: str, most_budgets: int = 1000) -> DataFrame:
    """The pieces of every text that has more UTF-8 bytes than the capacity of a ``split`` budget.

    One row per budget, id and piece: ``budget_id, id, piece_no, n_pieces, from_byte,
    to_byte, overlap_bytes, cut, piece``. Pieces without their overlap, in order, are
    the text. Null and empty texts, and texts within the capacity, give no rows; repeated
    rows are cut each; other columns are not read. ``budgets`` is a table of settings and
    read on the driver; more than ``most_budgets`` of them are an error.
    """
    chosen = budgets.filter("purpose = 'split' and measure = 'utf8_bytes' and capacity is not null").select("budget_id", "capacity", F.coalesce("overlap", F.lit(0)).alias("overlap")).limit(most_budgets + 1).collect()
    if len(chosen) > most_budgets:
        raise ValueError("too many budgets")
    settings = [(r.budget_id, r.capacity, r.overlap) for r in chosen]
    least = min((c for _, c, _ in settings), default=None)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.filter(F.lit(False) if least is None else F.octet_length("text") > least)
    return rows.mapInArrow(lambda batches: _split(batches, settings), _SCHEMA)
