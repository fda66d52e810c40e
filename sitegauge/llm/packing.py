"""Filling containers of fixed capacity (problem 7).

Sizes are tokens of a public tokenizer. The histogram of sizes, whose length the
capacity bounds, is all that reaches the driver. There patterns of a few sizes that
fill a container are enumerated on a grid, their repeat counts are fitted to the
histogram by non-negative least squares and rounded down. The last item of every
container is chosen by the room that is really left, and what remains is packed best fit
first, into gaps of the patterns and then into new containers. The plan says
which ranks of every size go where; the items are ranked and placed in parallel.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the rank file's vocabulary splits text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    encode = load_tokenizer(SparkFiles.get(name)).encode_ordinary
    for batch in batches:
        ids, counts = [], []
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text and text.strip():
                ids.append(id_)
                counts.append(len(encode(text)))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_tokens"])


def token_sizes(df: DataFrame, id_col: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``id, n_tokens`` of every text that is not blank. The tokenizer's file lies where the
    driver runs and is sent to the executors."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)
    return df.select(F.col(id_col).cast("bigint"), F.col(text).cast("string")).mapInArrow(lambda b: _sizes(b, name), "id bigint, n_tokens bigint")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by active sets."""
    n = a.shape[1]
    x = np.zeros(n)
    free = np.zeros(n, bool)
    gradient = a.T @ b
    tolerance = 1e-9 * max(1.0, np.abs(gradient).max(initial=0.0))
    for _ in range(rounds):
        open_ = np.where(free, -np.inf, gradient)
        j = int(np.argmax(open_)) if n else 0
        if not n or open_[j] <= tolerance:
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min(initial=1.0) > 0:
                x = s
                break
            low = free & (s <= 0)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-10
            x[~free] = 0.0
            if not free.any():
                break
        gradient = a.T @ (b - a @ x)
    return x


def _patterns(bins: list[int], full: int) -> list[Counter[int]]:
    """Multisets of one to three of the bins that fill ``full`` exactly, or all but one step of it."""
    have = sorted(bins)
    there = set(have)
    found = {(b,) for b in have if full - 1 <= b <= full}
    for i, a in enumerate(have):
        for t in (full, full - 1):
            if t - a in there and t - a >= a:
                found.add((a, t - a))
        for b in have[i:]:
            for t in (full, full - 1):
                c = t - a - b
                if c >= b and c in there:
                    found.add((a, b, c))
    return [Counter(p) for p in sorted(found)]


def _largest(sizes: list[int], left: dict[int, int], taken: Counter[int], room: int) -> int | None:
    """The largest size not used up that fits ``room``; sizes used up for good are dropped."""
    k = bisect.bisect_right(sizes, room)
    while k:
        s = sizes[k - 1]
        if left[s] > taken[s]:
            return s
        if left[s] == 0:
            del sizes[k - 1]
        k -= 1
    return None


def _pattern_groups(left: dict[int, int], capacity: int, grid: int) -> list[tuple[dict[int, int], int]]:
    """Containers by the fitted patterns; what they use is taken off ``left``.

    A pattern says which bins its items come from; the last one, and whatever still fits
    then, is the largest size that there is for the room that is really left.
    """
    width = max(1, -(-capacity // grid))
    full = capacity // width
    of_bin: dict[int, list[int]] = {}
    for s in sorted(left, reverse=True):
        of_bin.setdefault(-(-s // width), []).append(s)
    bins = sorted(b for b in of_bin if b <= full)
    patterns = _patterns(bins, full)
    if not patterns:
        return []
    at = {b: i for i, b in enumerate(bins)}
    a = np.zeros((len(bins), len(patterns)))
    for k, p in enumerate(patterns):
        for b, m in p.items():
            a[at[b], k] = m
    fitted = nnls(a, np.array([sum(left[s] for s in of_bin[b]) for b in bins], float))
    sizes = sorted(left)
    groups: list[tuple[dict[int, int], int]] = []
    for k in np.argsort(-fitted):
        repeats = int(fitted[k] + 1e-6)
        if repeats < 1:
            break
        *slots, _ = sorted(patterns[k].elements(), reverse=True)
        while repeats > 0:
            taken: Counter[int] = Counter()
            for b in slots:
                s = next((s for s in of_bin[b] if left[s] > taken[s]), None)
                if s is None:
                    break
                taken[s] += 1
            if sum(taken.values()) < len(slots):
                break
            room = capacity - sum(s * m for s, m in taken.items())
            while room and (s := _largest(sizes, left, taken, room)):
                taken[s] += 1
                room -= s
            if room:
                break
            run = min(repeats, *(left[s] // m for s, m in taken.items()))
            for s, m in taken.items():
                left[s] -= run * m
            groups.append((dict(taken), run))
            repeats -= run
    return groups


def _best_fit(left: dict[int, int], capacity: int, groups: list[tuple[dict[int, int], int]]) -> list[tuple[dict[int, int], int]]:
    """``groups`` with the rest in, largest first into the tightest gap, and new containers."""
    open_: dict[int, list[list]] = {}
    for sizes, repeats in groups:
        open_.setdefault(capacity - sum(s * m for s, m in sizes.items()), []).append([sizes, repeats])
    for s in sorted((s for s, c in left.items() if c), reverse=True):
        count = left[s]
        while count:
            spaces = [f for f, g in open_.items() if f >= s and g]
            if spaces:
                free = min(spaces)
                sizes, repeats = open_[free].pop()
                m = min(free // s, count)
                fill = min(repeats, count // m)
                if repeats > fill:
                    open_[free].append([sizes, repeats - fill])
                count -= fill * m
            else:
                free, sizes = capacity, {}
                m = min(capacity // s, count)
                fill = count // m
                count -= fill * m
            grown = dict(sizes)
            grown[s] = grown.get(s, 0) + m
            open_.setdefault(free - m * s, []).append([grown, fill])
    return [(sizes, repeats) for groups in open_.values() for sizes, repeats in groups if repeats]


def plan_containers(histogram: dict[int, int], capacity: int, grid: int = 128) -> list[tuple[dict[int, int], int]]:
    """Containers as ``(sizes with their counts, repeats)`` that use up the histogram.

    The plan by patterns and the one by best fit alone are both made, as the histogram is
    small, and the one of fewer containers stands; of equal ones that by patterns.
    """
    left = {s: c for s, c in histogram.items() if c > 0}
    alone = _best_fit(left, capacity, [])
    rest = dict(left)
    groups = _pattern_groups(rest, capacity, grid)
    plan = _best_fit(rest, capacity, groups)
    return min(plan, alone, key=lambda groups: sum(repeats for _, repeats in groups))


def _intervals(groups: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per size the first rank, first container and items per container of each run."""
    begin: Counter[int] = Counter()
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for sizes, repeats in groups:
        for s, m in sizes.items():
            runs.setdefault(s, []).append((begin[s], base, m))
            begin[s] += m * repeats
        base += repeats
    return {s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in runs.items()}


def _place(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    intervals = shared.value
    for batch in batches:
        size = batch.column(2).to_numpy(zero_copy_only=False)
        rank = batch.column(3).to_numpy(zero_copy_only=False)
        container = np.zeros(len(size), np.int64)
        for s in np.unique(size):
            first, base, m = intervals[int(s)]
            rows = np.flatnonzero(size == s)
            k = np.searchsorted(first, rank[rows], side="right") - 1
            container[rows] = base[k] + (rank[rows] - first[k]) // m[k]
        yield pa.record_batch([pa.array(container), batch.column(0), batch.column(1), batch.column(2)], names=["container_id", "id", "piece_no", "n_tokens"])


def pack(sizes: DataFrame, capacity: int, salts: int = 64) -> DataFrame:
    """``container_id, id, piece_no, n_tokens``: every item of ``id, n_tokens`` in a container.

    An item larger than the capacity becomes full pieces and a rest; no other item is
    split, and no container exceeds the capacity. Null sizes and sizes below one are
    left out; repeated rows are items of their own; no items give no containers. Equal
    sizes, however many, are ranked in ``salts`` independent runs.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kept = sizes.filter("n_tokens >= 1")
    count = F.ceil(F.col("n_tokens") / F.lit(capacity)).cast("int")
    pieces = kept.select("id", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece_no"), "n_tokens")
    size = F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no").cast("bigint") * capacity)
    pieces = pieces.select("id", "piece_no", size.cast("bigint").alias("size"), F.pmod(F.xxhash64("id", "piece_no"), F.lit(salts)).cast("int").alias("salt"))
    counts = pieces.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).drop("n")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    shared = sizes.sparkSession.sparkContext.broadcast(_intervals(plan_containers(histogram, capacity)))
    order = Window.partitionBy("size", "salt").orderBy("id", "piece_no")
    ranked = pieces.withColumn("at", F.row_number().over(order) - 1).join(before, ["size", "salt"])
    ranked = ranked.select("id", "piece_no", "size", (F.col("at") + F.col("before")).cast("bigint").alias("rank"))
    return ranked.mapInArrow(lambda b: _place(b, shared), "container_id bigint, id bigint, piece_no int, n_tokens bigint")


def pack_budgets(df: DataFrame, budgets: DataFrame, id_col: str, text: str, tokenizer: str = TOKENIZER, most_budgets: int = 1000) -> DataFrame:
    """``pack`` for every ``pack`` budget measured in tokens, ``budget_id`` in front."""
    chosen = budgets.filter("purpose = 'pack' and measure = 'tokens' and capacity is not null").orderBy("budget_id").select("budget_id", "capacity").limit(most_budgets + 1).collect()
    if not 0 < len(chosen) <= most_budgets:
        raise ValueError(f"{len(chosen)} pack budgets; one to {most_budgets} are expected")
    sizes = cut_lineage(token_sizes(df, id_col, text, tokenizer))
    out = None
    for r in chosen:
        part = pack(sizes, r.capacity).select(F.lit(r.budget_id).alias("budget_id"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def containers(members: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budget_id, container_id, n_members, n_tokens, fill`` of ``pack_budgets``'s rows."""
    used = members.groupBy("budget_id", "container_id").agg(F.count("*").alias("n_members"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(budgets.select("budget_id", "capacity"), "budget_id").select("budget_id", "container_id", "n_members", "n_tokens", (F.col("n_tokens") / F.col("capacity")).alias("fill"))
