"""Triple patterns and the joins between them.

quads: (rid, s, p, o), terms as tagged strings. Solutions: rid and one column a variable, NULL where unbound. All
joins are equi-joins on rid and the shared variables, so after one ``repartition('rid')`` they need no further
shuffle (with spark.sql.requireAllClusterKeysForCoPartition=false, see ``colocated``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RID = "rid"


def variables(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != RID]


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in variables(left) if c in right.columns]


def colocated(quads: DataFrame) -> DataFrame:
    """Quads dealt by record, as a set; joins and aggregations by rid then stay where they are."""
    quads.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return quads.select(RID, "s", "p", "o").repartition(RID).dropDuplicates()


def pattern(quads: DataFrame, s, p, o) -> DataFrame:
    """Solutions of one triple pattern. '?name' is a variable, anything else a term; a repeated variable must agree."""
    df, names = quads, {}
    for position, want in zip(("s", "p", "o"), (s, p, o), strict=True):
        if isinstance(want, str) and want.startswith("?"):
            name = want[1:]
            if name in names:
                df = df.filter(F.col(position) == F.col(names[name]))
            else:
                names[name] = position
        else:
            df = df.filter(F.col(position) == want)
    return df.select(RID, *(F.col(position).alias(name) for name, position in names.items()))


def join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Natural join: rid and all shared variables, which must be bound on both sides. Without shared variables: within the record."""
    return left.join(right, [RID, *shared(left, right)])


def bgp(quads: DataFrame, *patterns) -> DataFrame:
    """Join of triple patterns, in the order given."""
    return reduce(join, (pattern(quads, *p) for p in patterns))


def star(subjects: DataFrame, s: str, *patterns) -> DataFrame:
    """Join of the triple patterns (s, predicate, object) of one subject variable, over a property table (``triples.property_table``).

    A subject is one row with at most one object a predicate, so the join is a selection: the table is read once, not once a pattern."""
    df, names = subjects, {s[1:]: "s"}
    for predicate, want in patterns:
        position = f"`{predicate}`"
        if not isinstance(want, str) or not want.startswith("?"):
            df = df.filter(F.col(position) == want)
        elif want[1:] in names:
            df = df.filter(F.col(position) == F.col(names[want[1:]]))
        else:
            df, names[want[1:]] = df.filter(F.col(position).isNotNull()), position
    return df.select(RID, *(F.col(position).alias(name) for name, position in names.items()))


def compatible_join(left: DataFrame, right: DataFrame, maybe: list[str]) -> DataFrame:
    """Join in which the variables of ``maybe`` may be unbound: they agree if equal or if either is unbound.

    Rows are parted by what is bound, so every part is an equi-join; the parts are disjoint, so their union is the bag."""
    certain = [c for c in shared(left, right) if c not in maybe]
    both = [c for c in maybe if c in left.columns and c in right.columns]

    def parts(df: DataFrame):
        for bits in range(1 << len(both)):
            bound = [c for i, c in enumerate(both) if bits >> i & 1]
            yield set(bound), reduce(lambda d, c: d.filter(F.col(c).isNotNull() if c in bound else F.col(c).isNull()), both, df)

    out = []
    for bl, l in parts(left):
        for br, r in parts(right):
            keys = [RID, *certain, *(c for c in both if c in bl and c in br)]
            l2 = l.drop(*(c for c in both if c not in bl))
            r2 = r.drop(*(c for c in both if c not in br))
            got = l2.join(r2, keys)
            for c in both:
                if c not in got.columns:
                    got = got.withColumn(c, F.lit(None).cast("string"))
            out.append(got)
    return reduce(DataFrame.unionByName, out)


def optional(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Left outer join on the shared variables; the condition may read both sides and is part of the match."""
    keys = [RID, *shared(left, right)]
    if condition is None:
        return left.join(right, keys, "left")
    renamed = right.select(*(F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns))
    on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__{c}") for c in keys)) & F.coalesce(condition, F.lit(False))
    return left.join(renamed, on, "left").drop(*(f"__{c}" for c in keys))


def minus(left: DataFrame, right: DataFrame, maybe: list[str] = ()) -> DataFrame:
    """Rows of left without a compatible row in right that shares a bound variable; nothing shared: left as it is."""
    common = shared(left, right)
    if not common:
        return left
    if not maybe:
        return left.join(right.select(RID, *common), [RID, *common], "left_anti")
    certain = [c for c in common if c not in maybe]
    out = left
    for bits in range(1 << len(maybe)):
        bound = [c for i, c in enumerate(maybe) if bits >> i & 1]
        if not certain and not bound:
            continue
        r = reduce(lambda d, c: d.filter(F.col(c).isNotNull() if c in bound else F.col(c).isNull()), maybe, right)
        for own in range(1 << len(bound)):
            keys = [RID, *certain, *(c for i, c in enumerate(bound) if own >> i & 1)]
            free = [c for i, c in enumerate(bound) if not own >> i & 1]
            if len(keys) == 1:
                continue
            r2 = r.select(*(F.col(c).alias(f"__{c}") for c in keys)).distinct()
            on = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__{c}") for c in keys))
            for c in free:
                on = on & F.col(c).isNull()
            out = out.join(r2, on, "left_anti")
    return out


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [RID, *shared(left, right)], "left_semi")


def not_exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [RID, *shared(left, right)], "left_anti")


def exists_flag(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """EXISTS inside an expression: a boolean column."""
    keys = [RID, *shared(left, right)]
    found = right.select(*keys).distinct().withColumn(name, F.lit(True))
    return left.join(found, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def values(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """An inline table; None is UNDEF. It belongs to every record, so it has no rid."""
    from pyspark.sql import types as T

    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def join_values(left: DataFrame, table: DataFrame) -> DataFrame:
    """Join with an inline table: UNDEF agrees with anything; an unbound variable takes the table's value."""
    names = [c for c in table.columns if c in left.columns]
    renamed = table.select(*(F.col(c).alias(f"__{c}") if c in names else F.col(c) for c in table.columns))
    on = reduce(lambda a, b: a & b, (F.col(f"__{c}").isNull() | F.col(c).isNull() | (F.col(c) == F.col(f"__{c}")) for c in names), F.lit(True))
    got = left.join(F.broadcast(renamed), on)  # an inline table is query text, not data
    return got.select(*(F.coalesce(c, f"__{c}").alias(c) if c in names else c for c in [*left.columns, *(c for c in table.columns if c not in names)]))


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """BIND: an error leaves the variable unbound."""
    return df.withColumn(name, value)


def agree(df: DataFrame, name: str, value: Column) -> DataFrame:
    """BIND of a variable that may be bound already: rows stay where it is unbound or has the value."""
    return df.withColumn("__v", value).filter(F.col(name).isNull() | F.col("__v").isNull() | (F.col(name) == F.col("__v"))).withColumn(name, F.coalesce(name, "__v")).drop("__v")


def union(*branches: DataFrame) -> DataFrame:
    """Bag union; a variable that a branch lacks is unbound in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def limited(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET, for each record by itself. The order should be total."""
    n = F.row_number().over(W.partitionBy(RID).orderBy(*order))
    out = df.withColumn("__n", n).filter(F.col("__n") > offset)
    return (out if limit is None else out.filter(F.col("__n") <= offset + limit)).drop("__n")


def ask(records: DataFrame, solutions: DataFrame, name: str = "found") -> DataFrame:
    """ASK for every record: does it have a solution?"""
    return records.select(RID).join(solutions.select(RID).distinct().withColumn(name, F.lit(True)), RID, "left").withColumn(name, F.coalesce(name, F.lit(False)))
