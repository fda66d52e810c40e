"""Joining members back to their classes when one class may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _salt(spread_by: str | Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")


def join_classes(members: DataFrame, classes: DataFrame, key: str, size: Column, spread_by: str, salts: int = 16) -> DataFrame:
    """Inner join of ``members`` with ``classes`` (one row per ``key``).

    ``size`` is the member count of a class, or a bound of it; see ``attach_classes``.
    """
    sized = classes.withColumn("_size", size).withColumn("_matched", F.lit(True))
    return attach_classes(members, sized, key, "_size", spread_by, salts).filter("_matched").drop("_matched")


def attach_classes(members: DataFrame, classes: DataFrame, key: str, size: str, spread_by: str, salts: int = 16) -> DataFrame:
    """Left join of ``members`` with ``classes`` (one row per ``key``): every member once.

    ``size`` is the member count of a class. Classes of over a thousand members a salt are
    joined first, on the key and a salt of the member's ``spread_by`` column, the class row
    being repeated once per salt; their members are then sent through the join of
    the others under keys of their own, so no task gets a whole large class. A null key has no class. The column ``size`` is dropped.
    """
    given = [c for c in classes.columns if c not in (key, size)]
    large = F.col(size) > 1000 * salts
    hot = classes.filter(large).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hot = hot.select(F.col(key).alias("_hot"), "_salt", *[F.col(c).alias(f"_hot_{c}") for c in given])
    rest = classes.filter(~large).select(F.col(key).alias("_rest"), *[F.col(c).alias(f"_rest_{c}") for c in given])
    spread = members.withColumn("_salt", _salt(spread_by, salts))
    first = spread.join(hot, (F.col(key) == F.col("_hot")) & (spread["_salt"] == hot["_salt"]), "left").drop(spread["_salt"]).drop(hot["_salt"])
    own = F.concat(F.lit("\x00"), F.xxhash64(spread_by, F.monotonically_increasing_id()).cast("string")).cast(members.schema[key].dataType)
    second = first.withColumn("_own", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), own).otherwise(F.col(key)))
    both = second.join(rest, F.col("_own") == F.col("_rest"), "left")
    return both.select(*members.columns, *[F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in given])
