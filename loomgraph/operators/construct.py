"""CONSTRUCT: templates over solutions, blank nodes and sets of triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import terms as t


def blank_of_row(query: str, label: str, *key: Column) -> Column:
    """A template's blank node: one for each solution row, from the row's content, so that retries make the same node."""
    return t.blank(F.substring(F.sha2(F.concat_ws("|", F.lit(query), F.lit(label), *(F.coalesce(k, F.lit("")) for k in key)).cast("binary"), 256), 1, 32))


def construct(solutions: DataFrame, *template: tuple) -> DataFrame:
    """Triples (rid, s, p, o) of a template. A triple with an unbound place, a literal subject or a predicate that is no IRI
    is left out. Equal triples of a record come once."""
    col = lambda x: F.col(x[1:]) if isinstance(x, str) and x.startswith("?") else x if isinstance(x, Column) else F.lit(x)
    triples = F.array(*(F.struct(col(s).alias("s"), col(p).alias("p"), col(o).alias("o")) for s, p, o in template))
    out = solutions.select("rid", F.inline(triples))
    fits = t.kind(F.col("s")).isin("I", "B") & (t.kind(F.col("p")) == "I") & F.col("o").isNotNull()
    return out.filter(fits).dropDuplicates(["rid", "s", "p", "o"])


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one bag has more often than the other, with the side that has them."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))
