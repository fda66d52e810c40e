"""Evaluation passages inside training text (problem 8).

The passages become one generalised suffix automaton over normalised words, built once
and shared as flat arrays. Each document is streamed through it once; the matching
statistics (the longest suffix of what was read that occurs in a passage) give seeds,
which are then measured: how much of the passage the text carries, in at most two
stretches, each with its place in the text, so that it can be removed.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[a-zA-Z/!][^<>]*>")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z]{2,8});")
_BROKEN = re.compile(r"(?<=\w)(?:=|-|­)\r?\n[ \t>|#*]*(?=[^\W\d_])")
_STOP = re.compile(r"[.!?。！？؟।]+")
_LABEL = re.compile(r"(?:^[^\w\n]*|(?<=[.!?])\s+|(?<=[。！？؟।])\s*)(question|answer|q|a)\s*\d*\s*[:：]", re.I | re.M)
_GOES_ON = regex.compile(r"[\p{Ll}\p{N}_&=%/]")
_CLUSTER = regex.compile(r"\X")

HITS = "array<struct<item_id: bigint, coverage: double, spans: array<struct<begin: int, end: int>>>>"
_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("spans", pa.list_(_SPAN))]))
START, END = (), ("\x00",)


def words(text: str) -> list[str]:
    """Normalised words: compatibility forms folded, tags and soft line breaks dropped, lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("­", "").replace("\u200b", "")
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    return _WORD.findall(text.lower())


def word_places(text: str) -> list[tuple[int, int]]:
    """``(begin, end)`` in the text as it stands of every word that ``words`` gives."""
    pieces: list[str] = []
    at: list[int] = []
    until: list[int] = []
    if text.isascii():
        folded, at, until = text, list(range(len(text))), list(range(1, len(text) + 1))
    else:
        for m in _CLUSTER.finditer(text):
            piece = unicodedata.normalize("NFKC", m[0]).replace("­", "").replace("\u200b", "")
            pieces.append(piece)
            at += [m.start()] * len(piece)
            until += [m.end()] * len(piece)
        folded = "".join(pieces)
    for pattern, stand_in in ((_BROKEN, ""), (_TAG, " "), (_ENTITY, " ")):
        kept, begin = [], 0
        new_at: list[int] = []
        new_until: list[int] = []
        for m in pattern.finditer(folded):
            kept += [folded[begin : m.start()], stand_in]
            new_at += at[begin : m.start()] + [at[m.start()]] * len(stand_in)
            new_until += until[begin : m.start()] + [until[m.end() - 1]] * len(stand_in)
            begin = m.end()
        if begin:
            folded = "".join([*kept, folded[begin:]])
            at, until = new_at + at[begin:], new_until + until[begin:]
    low = folded.lower()
    if len(low) != len(folded):
        sizes = [len(c.lower()) for c in folded]
        at = [a for a, n in zip(at, sizes) for _ in range(n)]
        until = [u for u, n in zip(until, sizes) for _ in range(n)]
        low = "".join(c.lower() for c in folded)
    return [(at[m.start()], until[m.end() - 1]) for m in _WORD.finditer(low)]


def _instructions(texts: list[tuple[tuple[str, ...], ...]], stock: int) -> list[int]:
    """How many of its first sentences each text shares with others only as an opening.

    An opening is where the texts that begin alike part into ``stock`` different ones or
    more, over no more than half of the text. Texts of one passage do not part."""
    step: dict[tuple[int, tuple[str, ...]], int] = {}
    ways: Counter = Counter()
    paths = []
    for parts in texts:
        path = [0]
        for part in (*parts, END):
            at = path[-1], part
            if at not in step:
                step[at] = len(step) + 1
                ways[path[-1]] += 1
            path.append(step[at])
        paths.append(path)
    return [max((n for n in range(1, len(parts) // 2 + 1) if ways[path[n]] >= stock), default=0) for parts, path in zip(texts, paths)]


def _asked(text: str) -> int:
    """Where an item's question begins, or the length of a text without one.

    Labels decide (of the last kind of question and answer the first), or else the last
    sentence or line that asks, as a passage may ask too. Nothing before which no word
    stands is a question."""
    labels = [(m[1].lower(), m.start()) for m in _LABEL.finditer(text)]
    labels = [one for one, other in zip(labels, labels[1:]) if (one[0], other[0]) in (("question", "answer"), ("q", "a"))]
    if labels:
        return next((n for kind, n in labels if kind == labels[-1][0] and words(text[:n])), len(text))
    begin = asked = 0
    for m in _STOP.finditer(text):
        if set(m[0]) & set("?？؟") and not _GOES_ON.match(text, m.end()):
            asked = max(begin, text.rfind("\n", begin, m.start()) + 1)
        begin = m.end()
    return asked if words(text[:asked]) else len(text)


def passages(items: Iterable[tuple[int, str]], stock: int = 3) -> dict[tuple[str, ...], list[int]]:
    """The words of every different passage, with the items that use it.

    A passage is all of an item before its question, however many sentences these are, without
    the instruction it opens or closes with: that is what ``stock`` or more different passages
    have in common there and nothing else. Items of one passage all get it, however many they
    are. A null text or one without words has no passage and is left out.
    """
    ids, texts = [], []
    for i, text in items:
        text = text or ""
        parts = tuple(tuple(found) for x in _STOP.split(text[: _asked(text)]) if (found := words(x)))
        if parts:
            ids.append(i)
            texts.append(parts)
    openings = _instructions(texts, stock)
    rest = [t[n:] for t, n in zip(texts, openings)]
    closings = _instructions([t[::-1] for t in rest], stock)
    found: dict[tuple[str, ...], list[int]] = {}
    for i, t, n in zip(ids, rest, closings):
        found.setdefault(tuple(w for part in t[: len(t) - n] for w in part), []).append(i)
    return {t: sorted(set(of)) for t, of in found.items()}


def families(texts: list[tuple[str, ...]], width: int = 8, share: float = 0.4) -> list[int]:
    """The family of each passage: a passage that has ``share`` of its runs of ``width`` words
    in common with an earlier one belongs to that one's family."""
    parent = list(range(len(texts)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    holder: dict[int, int] = {}
    for k, text in enumerate(texts):
        runs = {hash(text[n : n + width]) for n in range(max(1, len(text) - width + 1))}
        shared = Counter(root(holder[r]) for r in runs if r in holder)
        if shared:
            best, n = max(shared.items(), key=lambda x: (x[1], -x[0]))
            if n >= share * len(runs):
                parent[root(k)] = best
        for r in runs:
            holder.setdefault(r, k)
    return [root(k) for k in range(len(texts))]


def own_words(texts: list[tuple[str, ...]], family: list[int], shared_by: int, least: float = 0.1) -> list[list[bool]]:
    """Which words of each passage belong to it and not to wording that passages share.

    Shared wording is a run of ``n`` words that more than ``shared_by`` families have. ``n``
    is 2; a passage of which that leaves less than the share ``least`` takes the next ``n``.
    """
    out: list[list[bool] | None] = [None] * len(texts)
    todo = list(range(len(texts)))
    for n in range(2, 9):
        if not todo:
            break
        first: dict[int, list[int]] = {}
        for k, text in enumerate(texts):
            for j in range(len(text) - n + 1):
                held = first.setdefault(hash(text[j : j + n]), [])
                if len(held) <= shared_by and family[k] not in held:
                    held.append(family[k])
        left = []
        for k in todo:
            text = texts[k]
            own = [True] * len(text)
            for j in range(len(text) - n + 1):
                if len(first[hash(text[j : j + n])]) > shared_by:
                    own[j : j + n] = [False] * n
            out[k] = own
            if sum(own) < least * len(own):
                left.append(k)
        todo = left
    return out


class Automaton:
    """Generalised suffix automaton over the words of numbered passages."""

    def __init__(self, texts: dict[int, list[str]]):
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.texts = {}
        for item, text in texts.items():
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text]
            self.texts[item] = ids
            last = 0
            for c in ids:
                last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def arrays(self, own: dict[int, list[bool]], least: int) -> dict:
        """The automaton as flat arrays. Every state of a run of ``least`` words or more lists
        the passages in which that run has a word of its own, with the place where it ends."""
        word, follow, keys, targets = array("i"), array("i"), array("q"), array("i")
        width = len(self.vocabulary) + 1
        for state, steps in enumerate(self.next):
            (c, t) = next(iter(steps.items())) if len(steps) == 1 else (-1, 0)
            word.append(c)
            follow.append(t)
            if len(steps) > 1:
                for c, t in steps.items():
                    keys.append(state * width + c)
                    targets.append(t)
        holders: dict[int, dict[int, int]] = defaultdict(dict)
        for item, ids in self.texts.items():
            before = [0]
            for flag in own[item]:
                before.append(before[-1] + flag)
            state = 0
            for k, c in enumerate(ids):
                state = self.next[state][c]
                s = state
                while s > 0 and self.length[s] >= least and item not in holders[s]:
                    if before[k + 1] > before[k + 1 - self.length[s]]:
                        holders[s][item] = k + 1
                    s = self.link[s]
        first, items, ends = array("i", [0]), array("i"), array("i")
        holders = {state: holding for state, holding in holders.items() if holding}
        for state in range(len(self.next)):
            for item, end in holders.get(state, {}).items():
                items.append(item)
                ends.append(end)
            first.append(len(items))
        # passages with a run of theirs in common: the longest match of one hides the other's
        parent = {i: i for i in self.texts}

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for holding in holders.values():
            one, *others = holding
            for other in others:
                parent[root(other)] = root(one)
        return {
            "vocabulary": list(self.vocabulary), "word": word, "follow": follow, "keys": keys, "targets": targets,
            "link": array("i", self.link), "length": array("i", self.length), "first": first, "items": items, "ends": ends,
            "texts": {i: array("i", t) for i, t in self.texts.items()}, "own": {i: bytes(own[i]) for i in self.texts},
            "group": {i: root(i) for i in self.texts},
        }


class Finder:
    """Measures how much of each passage a text carries."""

    def __init__(self, arrays: dict, users: dict[int, list[int]], seed_words: int, share: float, agreement: float):
        self.__dict__.update(arrays)
        self.number = {w: n for n, w in enumerate(self.vocabulary, 1)}
        self.more = dict(zip(self.keys, self.targets))
        self.texts = {i: list(t) for i, t in self.texts.items()}
        self.users, self.seed_words, self.share, self.agreement = users, seed_words, share, agreement
        self.members: dict[int, list[int]] = defaultdict(list)
        for passage, group in self.group.items():
            self.members[group].append(passage)

    def seeds(self, ids: list[int]) -> dict[int, list[tuple[int, int]]]:
        """Per passage the maximal matches ``(begin, end)`` of at least ``seed_words`` words
        that have a word of the passage's own."""
        word, follow, more, link, length, first = self.word, self.follow, self.more, self.link, self.length, self.first
        width, least = len(self.vocabulary) + 1, self.seed_words
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)

        def keep(state: int, size: int, at: int) -> None:
            if size >= least:
                for k in range(first[state], first[state + 1]):
                    item, end = self.items[k], self.ends[k]
                    if any(self.own[item][end - size : end]):
                        found[item].append((at - size, at))

        state = size = 0
        for at, c in enumerate(ids):
            if size == 0 and c == 0:
                continue
            t = follow[state] if word[state] == c else more.get(state * width + c, 0)
            if t:
                state, size = t, size + 1
                continue
            keep(state, size, at)
            if c == 0:
                state = size = 0
                continue
            while state:
                state = link[state]
                t = follow[state] if word[state] == c else more.get(state * width + c, 0)
                if t:
                    break
            state, size = (t, length[state] + 1) if t else (0, 0)
        keep(state, size, len(ids))
        return found

    def stretches(self, item: int, ids: list[int], runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Disjoint aligned stretches ``(item_from, item_to, text_from, text_to)``.

        Words are aligned along diagonals: a run fixes the shift between text and
        passage, and is prolonged both ways while the words agree often enough; a
        change of shift (a word lost or added) starts another diagonal, and
        diagonals that continue each other are joined.
        """
        passage = self.texts[item]
        blocks = set()
        for begin, end, k in runs:
            i, j = begin, k
            while i and j and ids[i - 1] == passage[j - 1]:
                i, j = i - 1, j - 1
            blocks.add((i, j, end - i))
        chains: list[list[tuple[int, int, int]]] = []
        # the chains by the shift of their last block; blocks come in the order of the text, so a chain left behind is done
        at_shift: dict[int, list[int]] = defaultdict(list)
        for i, j, n in sorted(blocks):
            best, until = -1, -1
            for shift in range(i - j - 5, i - j + 6):
                near = at_shift.get(shift)
                if not near:
                    continue
                near[:] = [c for c in near if i - sum(chains[c][-1][::2]) <= 12]
                for c in near:
                    pi, pj, pn = chains[c][-1]
                    if -3 <= i - (pi + pn) and -3 <= j - (pj + pn) <= 12 and i > pi and j > pj and (pi + pn, -c) > (until, -best):
                        best, until = c, pi + pn
            if best < 0:
                best = len(chains)
                chains.append([])
            else:
                at_shift[chains[best][-1][0] - chains[best][-1][1]].remove(best)
            chains[best].append((i, j, n))
            at_shift[i - j].append(best)
        out = []
        for chain in chains:
            i0, j0, _ = chain[0]
            i1, j1, n1 = chain[-1]
            out.append((j0, j1 + n1, i0, i1 + n1))
        return out

    def measure(self, item: int, ids: list[int], runs: list[tuple[int, int, int]]) -> tuple[float, list[tuple[int, int, int, int]]]:
        """The share of the passage in the best one or two stretches, and the stretches."""
        passage, own = self.texts[item], self.own[item]
        good = []
        for j0, j1, i0, i1 in self.stretches(item, ids, runs):
            got = Counter(ids[max(0, i0) : i1])
            hit = own_hit = own_all = 0
            for k in range(j0, j1):
                there = got[passage[k]] > 0
                if there:
                    got[passage[k]] -= 1
                hit += there
                own_all += own[k]
                own_hit += own[k] and there
            if hit >= self.agreement * (j1 - j0) and own_hit >= 0.6 * own_all and own_hit >= 1:
                good.append((j0, j1, i0, i1))
        good.sort(key=lambda s: s[0] - s[1])
        if not good:
            return 0.0, []
        best = [good[0]]
        for s in good[1:]:
            if s[1] <= best[0][0] or s[0] >= best[0][1]:
                best.append(s)
                break
        return sum(b - a for a, b, _, _ in best) / len(passage), best

    def find(self, text: str) -> list[tuple[int, float, list[tuple[int, int]]]]:
        """``(item, coverage, spans)`` of every item whose passage the text carries."""
        get = self.number.get
        ids = [get(w, 0) for w in words(text)]
        hits, places = [], None
        anchors: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for passage, seeds in self.seeds(ids).items():
            anchors[self.group[passage]] += seeds
        for group, around in anchors.items():
            for passage in self.members[group]:
                runs = self._runs(passage, ids, around)
                seeds = [(a, b) for a, b, k in runs if b - a >= self.seed_words and any(self.own[passage][k : k + b - a])]
                if len({ids[k] for s in seeds for k in range(*s)}) < 4:
                    continue
                coverage, best = self.measure(passage, ids, runs)
                if coverage >= self.share:
                    places = places or word_places(text)
                    last = len(places) - 1
                    spans = sorted((places[min(a, last)][0], places[min(b - 1, last)][1]) for _, _, a, b in best)
                    hits.extend((item, coverage, spans) for item in self.users[passage])
        return sorted(hits)

    def _runs(self, passage: int, ids: list[int], around: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """``(begin, end, place in the passage)`` of all common runs of two words or more that
        lie within a passage's length of the given matches."""
        text = self.texts[passage]
        pairs = defaultdict(list)
        for k in range(len(text) - 1):
            pairs[text[k], text[k + 1]].append(k)
        near: set[int] = set()
        for begin, end in around:
            near.update(range(max(0, begin - len(text)), min(len(ids) - 1, end + len(text))))
        found = []
        for i in sorted(near):
            for k in pairs.get((ids[i], ids[i + 1]), ()):
                if i and k and i - 1 in near and ids[i - 1] == text[k - 1]:
                    continue
                n = 2
                while i + n < len(ids) and k + n < len(text) and ids[i + n] == text[k + n]:
                    n += 1
                found.append((i, i + n, k))
        return found


_LATEST: list[tuple[dict, Finder]] = []


def _finder(shared) -> Finder:
    """The finder of a broadcast plan, made once in a worker process."""
    plan = shared.value
    if not _LATEST or _LATEST[0][0] is not plan:
        _LATEST[:] = [(plan, Finder(**plan))]
    return _LATEST[0][1]


def _annotate(batches: Iterator[pa.RecordBatch], shared, keep_text: bool) -> Iterator[pa.RecordBatch]:
    finder = _finder(shared)
    for batch in batches:
        hits = []
        texts = batch.column(1).to_pylist()
        for text, before in zip(texts, batch.column(2).to_pylist()):
            found = [{"item_id": i, "coverage": c, "spans": [{"begin": a, "end": b} for a, b in spans]} for i, c, spans in (finder.find(text) if text else ())]
            hits.append((before or []) + found)
        if keep_text:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hits, _HITS)], names=["doc_id", "text", "hits"])
        else:
            rows = [k for k, h in enumerate(hits) if h]
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([hits[k] for k in rows], _HITS)], names=["doc_id", "hits"])


def _plans(items: DataFrame, item_id: str, item_text: str, share: float, agreement: float, seed_words: int, shared_by: int, block_bytes: int) -> list[dict]:
    """One plan per block of passages. What passages share is counted over all of them first,
    so the size of the blocks does not change what is found."""
    chosen = items.select(F.col(item_id).cast("bigint"), F.col(item_text).cast("string")).dropna().distinct().orderBy(F.col(item_id), F.col(item_text))
    users = passages((i, t) for i, t in chosen.toLocalIterator())
    texts = sorted(users)
    own = own_words(texts, families(texts), shared_by)
    blocks: list[list[int]] = []
    room = -1
    for k, text in enumerate(texts):
        size = sum(map(len, text)) + len(text)
        if room < size:
            blocks.append([])
            room = block_bytes
        blocks[-1].append(k)
        room -= size
    plans = []
    for block in blocks:
        automaton = Automaton({k: list(texts[k]) for k in block})
        arrays = automaton.arrays({k: own[k] for k in block}, seed_words)
        plans.append({"arrays": arrays, "users": {k: users[texts[k]] for k in block}, "seed_words": seed_words, "share": share, "agreement": agreement})
    return plans


def annotated_documents(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: float = 0.36,
    agreement: float = 0.75,
    seed_words: int = 3,
    shared_by: int = 2,
    block_bytes: int = 2_000_000,
    keep_text: bool = True,
) -> DataFrame:
    """``doc_id, text, hits`` of every document; ``hits`` has ``item_id, coverage, spans`` for every
    item of whose passage the text holds ``share`` or more in one or two stretches. The
    default is two fifths less the altered words that a stretch may end in. ``spans`` are
    the character places ``begin`` to ``end`` of the stretches. Without ``keep_text`` only
    documents with hits come out, without their text.

    The items are a stated, bounded set, and the driver holds their words: they are taken
    in blocks of at most ``block_bytes`` of passages, one pass over the documents each, so
    no broadcast outgrows its bound (some 40 bytes of arrays per byte of passage). Within a stretch at least
    ``agreement`` of the passage's words and 0.6 of those that are not wording of more than
    ``shared_by`` families of passages must agree. Null and empty texts hold nothing; a
    document without an id is reported under null; repeated item rows count once.
    """
    spark = docs.sparkSession
    out = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.lit(None).cast(HITS).alias("hits"))
    plans = _plans(items, item_id, item_text, share, agreement, seed_words, shared_by, block_bytes)
    for n, plan in enumerate(plans, 1):
        kept = keep_text or n < len(plans)
        shared = spark.sparkContext.broadcast(plan)
        schema = f"doc_id bigint, text string, hits {HITS}" if kept else f"doc_id bigint, hits {HITS}"
        out = out.mapInArrow(lambda batches, shared=shared, kept=kept: _annotate(batches, shared, kept), schema)
    return out if keep_text else out.select("doc_id", "hits")


def leaked_passages(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, coverage, spans``: one row per document and item of
    ``annotated_documents``, which takes the same ``options``. A document row that is
    repeated is reported once; no items or no documents give no rows."""
    found = annotated_documents(docs, items, keep_text=False, **options).filter("hits is not null").select("doc_id", F.explode("hits").alias("h"))
    rows = found.select("doc_id", "h.*")
    return rows.groupBy("doc_id", "item_id").agg(F.max_by("coverage", "coverage").alias("coverage"), F.max_by("spans", "coverage").alias("spans"))


def cleaned_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, text, n_spans, n_removed`` of every document, the spans of its hits cut out.

    Spans that overlap are cut once; ``n_removed`` counts characters. Texts without a hit
    come as they are, null and empty ones too; repeated rows give repeated rows.
    """
    found = annotated_documents(docs, items, **options)
    spans = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("hits", F.array().cast(HITS)), lambda h: h["spans"]))))
    rows = found.select("doc_id", F.col("text").alias("_t"), spans.alias("spans"))

    def step(state, span):
        piece = F.substr(F.col("_t"), state["at"] + 1, F.greatest(F.lit(0), span["begin"] - state["at"]))
        cut = F.greatest(F.lit(0), span["end"] - F.greatest(state["at"], span["begin"]))
        return F.struct(F.concat(state["kept"], piece).alias("kept"), F.greatest(state["at"], span["end"]).alias("at"), (state["removed"] + cut).alias("removed"))

    begin = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"), F.lit(0).alias("removed"))
    rows = rows.withColumn("_s", F.when(F.size("spans") > 0, F.aggregate("spans", begin, step)))
    text = F.when(F.col("_s").isNull(), F.col("_t")).otherwise(F.concat("_s.kept", F.substr(F.col("_t"), F.col("_s.at") + 1, F.length("_t"))))
    return rows.select("doc_id", text.alias("text"), F.size("spans").alias("n_spans"), F.coalesce("_s.removed", F.lit(0)).alias("n_removed"))
