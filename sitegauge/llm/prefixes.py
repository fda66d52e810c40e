"""Strict-prefix self-join by sorting.

In sorted order the values that begin with ``v`` directly follow ``v``. So one
range-partitioned sort of the distinct values finds, for every value that is asked for,
whether a longer whole value begins with it, without comparing pairs: each task streams
its sorted run with a stack of nested values. What is still open at the end of a run is
settled by the first whole value of the next run that has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.session import cut_lineage

_OUT = "kind string, part int, value string"
_NAMES = ["kind", "part", "value"]
_TYPES = [pa.string(), pa.int32(), pa.string()]

#: Characters of a value that the bounds of the ranges are made of, in two steps.
_BOUND = 200


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    stack: list[str] = []
    begun = False

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    for batch in batches:
        rows: list[tuple] = []
        for value, asked, whole in zip(*(batch.column(i).to_pylist() for i in range(3))):
            while stack and not value.startswith(stack[-1]):
                stack.pop()
            if whole:
                if not begun:
                    rows.append(("head", part, value))
                    begun = True
                rows.extend(("longer", None, v) for v in stack)
                stack.clear()
            if asked:
                stack.append(value)
        if rows:
            yield out(rows)
    if stack:
        yield out([("tail", part, v) for v in stack])


def values_with_longer(rows: DataFrame) -> DataFrame:
    """``value``: every asked value of which a whole value is a strict continuation.

    ``rows`` has ``value`` string, ``asked`` and ``whole`` boolean; several rows of one value
    count as one that has either role if one of them has it. Null values are ignored; an
    equal value is no continuation; the empty value is a prefix of every other. Only
    distinct values are sorted, so a value that a third of all rows share is one row. The
    bounds of the ranges are taken from the first characters of a value, so what the driver
    samples stays small however long the values are; runs are streamed, so values that
    agree in all those characters make a long run, not a large one.
    """
    once = rows.filter("value is not null").groupBy("value").agg(F.max("asked").alias("asked"), F.max("whole").alias("whole"))
    bounds = [F.substring("value", 1, _BOUND), F.substring("value", _BOUND + 1, _BOUND)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the ranges are sampled from a table, not by running its plan a second time
    ordered = cut_lineage(once).repartitionByRange(parts, *bounds).sortWithinPartitions("value")
    scanned = cut_lineage(ordered.mapInArrow(_scan, _OUT))
    longer = scanned.filter("kind = 'longer'").select("value")
    # a tail is a value still open at the end of a run; the driver sees run numbers only
    heads = sorted(r["part"] for r in scanned.filter("kind = 'head'").select("part").collect())
    after = [(p, next((h for h in heads if h > p), None)) for p in range(parts)]
    following = rows.sparkSession.createDataFrame([(p, h) for p, h in after if h is not None] or [(-1, -1)], "part int, next int")
    tails = scanned.filter("kind = 'tail'").select("part", "value").join(F.broadcast(following), "part")
    first = scanned.filter("kind = 'head'").select(F.col("part").alias("next"), F.col("value").alias("_head"))
    settled = tails.join(first, "next").filter("startswith(_head, value) and _head <> value").select("value")
    return longer.unionByName(settled).distinct()
