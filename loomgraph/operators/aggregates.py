"""Grouping by record and keys, with SPARQL's rules for errors: one operand that is an error unbinds SUM, AVG, MIN and MAX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import terms as t

RID = "rid"


def _all_bound(x: Column) -> Column:
    return F.count_if(x.isNull()) == 0


def count_all() -> Column:
    return F.count(F.lit(1))


def count(x: Column) -> Column:
    return F.count(x)


def count_distinct(*x: Column) -> Column:
    return F.count_distinct(x[0] if len(x) == 1 else F.struct(*x))


def total(x: Column) -> Column:
    """SUM of integers: 0 over nothing, unbound with an error among the operands or past 64 bits."""
    return F.when(F.count(F.lit(1)) == 0, F.lit(0).cast("bigint")).when(_all_bound(x), F.try_sum(x))


def average(x: Column) -> Column:
    return F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).when(_all_bound(x), F.try_avg(x))


def least(term: Column) -> Column:
    return F.when(_all_bound(term), F.min_by(term, t.sort_key(term)))


def greatest(term: Column) -> Column:
    return F.when(_all_bound(term), F.max_by(term, t.sort_key(term)))


def sample(x: Column) -> Column:
    """Any bound value: always the smallest, so that results don't depend on partitions."""
    return F.min(x)


def group_concat(x: Column, order: list[Column], separator: str = " ") -> Column:
    """Texts in order, joined; an unbound operand unbinds the result; over nothing the empty string. Ties go by the text."""
    rows = F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), x.alias("x"))))
    return F.when(_all_bound(x), F.array_join(F.transform(rows, lambda r: r["x"]), separator))


def grouped(df: DataFrame, keys: list[str], records: DataFrame | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by record and keys. Without keys every record of ``records`` has a row, empty ones too."""
    if keys or records is None:
        return df.groupBy(RID, *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    # A record without solutions has no row to count: the marker tells its outer row from a real one.
    outer = records.select(RID).join(df.withColumn("__row", F.lit(True)), RID, "left")
    return outer.groupBy(RID).agg(*(c.alias(n) for n, c in aggregates.items()))


def row(x: Column) -> Column:
    """An operand of a keyless aggregate over outer rows: NULL in rows that only stand for an empty record."""
    return F.when(F.col("__row"), x)
