"""Corpus frequency of every distinct value and term (problem 4).

A term is a maximal run of Unicode letters and digits, lower-cased. Each task
keeps one last-seen counter per term: occurrences, records, and the number of
the last record that held it, so no set of records is ever built. A record
never straddles two tasks, therefore the per-task counters add up exactly; the
tasks emit them pre-aggregated and Spark hash-partitions them by term.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.session import cut_lineage

#: ``\w`` without the underscore is the letter and number categories.
TERM = re.compile(r"[^\W_]+")

_PARTIAL = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("n_occurrences", pa.int64()), ("n_records", pa.int64())])


def _count_batches(batches: Iterator[pa.RecordBatch], fields: list[str], flush_at: int) -> Iterator[pa.RecordBatch]:
    counters: list[dict[str, list[int]]] = [{} for _ in fields]
    record = 0
    told = 0

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal told
        # the rows read since the last time, under no field
        yield pa.record_batch([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([record - told], pa.int64())], schema=_PARTIAL)
        told = record
        for name, counter in zip(fields, counters):
            if counter:
                cells = list(counter.values())
                yield pa.record_batch(
                    [pa.array([name] * len(cells), pa.string()), pa.array(list(counter), pa.string()), pa.array([c[0] for c in cells], pa.int64()), pa.array([c[1] for c in cells], pa.int64())],
                    schema=_PARTIAL,
                )
                counter.clear()

    find = TERM.findall
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(len(fields))]
        for row in range(batch.num_rows):
            record += 1
            for counter, column in zip(counters, columns):
                text = column[row]
                if not text:
                    continue
                for term in map(str.lower, find(text)):
                    cell = counter.get(term)
                    if cell is None:
                        counter[term] = [1, 1, record]
                    else:
                        cell[0] += 1
                        if cell[2] != record:
                            cell[1] += 1
                            cell[2] = record
            if sum(map(len, counters)) > flush_at:
                yield from emit()
    yield from emit()


def _partial(df: DataFrame, fields: list[str], flush_at: int) -> DataFrame:
    picked = df.select(*[F.col(f"`{f}`").cast("string") for f in fields])
    return picked.mapInArrow(
        lambda batches: _count_batches(batches, fields, flush_at),
        "field_name string, term string, n_occurrences bigint, n_records bigint",
    )


def _summed(partial: DataFrame) -> DataFrame:
    rows = partial.filter("field_name is not null")
    return rows.groupBy("field_name", "term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def term_statistics(df: DataFrame, fields: list[str], flush_at: int = 400_000) -> DataFrame:
    """``field_name, term, n_occurrences, n_records`` for every term of each field.

    Null and empty cells hold no term; repeated rows are separate records; an
    empty table gives no rows; other columns are never read. ``flush_at`` bounds
    the terms a task holds: beyond it the counters are emitted, at the end of a
    record, and started anew.
    """
    return _summed(_partial(df, fields, flush_at))


def mark(n_records: Column, total: int, rare_at_most: int, common_over: float) -> Column:
    return F.when(n_records <= rare_at_most, "rare").when(n_records > F.lit(total) * F.lit(common_over), "common")


def marked_terms(df: DataFrame, fields: list[str], rare_at_most: int = 2, common_over: float = 0.2, flush_at: int = 400_000) -> DataFrame:
    """``term_statistics`` with ``mark``: ``rare`` if at most ``rare_at_most`` records hold
    the term, ``common`` if more than the share ``common_over`` of all rows do, else null.
    In a table so small that both hold, ``rare`` wins. The rows are counted in the same scan."""
    partial = cut_lineage(_partial(df, fields, flush_at))
    total = partial.filter("field_name is null").agg(F.sum("n_records").alias("n")).first()["n"] or 0
    return _summed(partial).withColumn("mark", mark(F.col("n_records"), total, rare_at_most, common_over))


def marked_values(df: DataFrame, fields: list[str], rare_at_most: int = 2, common_over: float = 0.2) -> DataFrame:
    """``field_name, value, n_occurrences, n_records, mark`` for every distinct value of each field.

    A null is no value; the empty string is one. A value occurs once in each record that
    holds it, so records and occurrences are the same number. ``mark`` as for terms; a null
    counts as a record.
    """
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields])).alias("r")).select("r.*")
    counted = cut_lineage(rows.groupBy("field_name", "value").agg(F.count("*").alias("n_records")))
    # every record has one value or a null in the first field
    total = counted.filter(F.col("field_name") == fields[0]).agg(F.sum("n_records").alias("n")).first()["n"] or 0
    marked = counted.filter("value is not null").withColumn("n_occurrences", F.col("n_records")).withColumn("mark", mark(F.col("n_records"), total, rare_at_most, common_over))
    return marked.select("field_name", "value", "n_occurrences", "n_records", "mark")
